"""Secret scans with an incremental blob ledger; DataFrame functions only.

Every version of a file is addressed by the SHA-256 of its content.  A ledger row (blob, rule, version,
spans) says that a blob was scanned with one version of a rule; only pairs not yet in the ledger are
scanned, once for each distinct content, and findings are joined back to every path with that content.
`advance` keeps the ledger as a Parquet table at a stated path: it reads what is there, scans what is unseen,
and appends that; rows that a lost job appended twice count once.

Spans come from one pass of each pattern: matches are enclosed in U+0001 marks (any U+0001 of the text
first becomes U+0002, which no pattern tells from it), the text is split at the marks, and running sums
of lengths give code-point offsets.  Sums run inside slices of the parts and then over the slices, so that
texts with very many matches take time in proportion to their length.

Defined cases: null texts count as empty; each row of a repeated path gets the findings; texts without
findings are in the ledger with no spans; empty tables give empty results; a text of any length is scanned as
a whole; paths are of any type; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern` whose group `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


#: Fixed values of the contract, in the order of kinds.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)


LEDGER = "blob string, kind string, version int, spans array<struct<start:int,end:int>>"
#: Parts of a text that are summed together; even, so that matches stand at odd places of each slice.
SLICE = 128


def spans_of(text, rule: Rule):
    """array<struct<start, end>> of a rule's matches, leftmost and non-overlapping, short ones dropped."""
    # (?s) isn't needed: no pattern has a dot.  $0 is the whole match.
    marked = F.regexp_replace(F.translate(text, "\u0001", "\u0002"), F.lit(rule.pattern), F.lit("\u0001$0\u0001"))
    spans = "array<struct<start:int,end:int>>"

    def piece(parts, c):
        """The length of slice c of the parts, and the spans in it from its own begin; matches stand at odd places."""
        step = F.transform(F.slice(parts, c * SLICE + 1, F.lit(SLICE)), lambda p, i: F.struct(
            F.char_length(p).alias("n"),
            ((i % 2 == 1) & (F.char_length(F.regexp_extract(p, rule.pattern, rule.group) if rule.group else p) >= rule.least)).alias("hit")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("found"))
        return F.aggregate(step, start, lambda acc, x: F.struct(
            (acc["at"] + x["n"]).alias("at"),
            F.when(x["hit"], F.array_append(acc["found"], F.struct(acc["at"].alias("start"), (acc["at"] + x["n"]).alias("end")))).otherwise(acc["found"]).alias("found")))

    def sliced(parts):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / SLICE).cast("int")), lambda c: piece(parts, c))

    def joined(slices):
        begins = F.aggregate(F.transform(slices, lambda x: x["at"]), F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
        return F.flatten(F.zip_with(slices, F.slice(begins, F.lit(1), F.size(slices)), lambda x, at: F.transform(x["found"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end")))))

    # Lambda variables hold what is used more than once, so that it is computed once.
    found = F.transform(F.transform(F.array(F.split(marked, "\u0001", -1)), sliced), joined)
    return F.when(F.instr(marked, "\u0001") > 0, found[0].cast(spans)).otherwise(F.array().cast(spans))


def scan(paths: DataFrame, ledger: DataFrame | None = None, *, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(new ledger rows, path and blob of every version).

    `ledger` has columns blob, kind, version, spans.  Versions are first reduced to narrow (path, blob) rows;
    the smallest path of an unseen blob brings the one copy of the content that is scanned.
    """
    spark = paths.sparkSession
    common.shared_dir(spark)
    own = paths.select(common.col(path_col).alias("path"), F.coalesce(common.col(text_col), F.lit("")).alias("content"))
    own = own.withColumn("blob", F.sha2("content", 256))
    versions = common.written(own.select("path", "blob"), "paths")
    first = versions.groupBy("blob").agg(F.min("path").alias("path"))
    known = None
    if ledger is not None:
        known = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", F.col("version").cast("int").alias("version"))).alias("seen"))
        first = first.join(known, "blob", "left")
        every = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
        first = first.where(F.coalesce(F.size(F.array_except(every, "seen")) > 0, F.lit(True)))
    else:
        first = first.withColumn("seen", F.lit(None).cast("array<struct<kind:string,version:int>>"))
    chosen = common.written(first.select(F.col("blob").alias("_b"), F.col("path").alias("_p"), "seen"), "unseen")
    if chosen.isEmpty():
        return spark.createDataFrame([], LEDGER), versions
    work = own.join(chosen, (F.col("blob") == F.col("_b")) & F.col("path").eqNullSafe(F.col("_p"))).select("blob", "content", "seen")
    scanned = []
    for r in rules:
        done = F.coalesce(F.array_contains("seen", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))), F.lit(False))
        scanned.append(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.when(~done, spans_of(F.col("content"), r)).alias("spans")))
    # A path that is repeated with the same content brings its blob more than once.
    rows = work.select("blob", F.explode(F.array(*scanned)).alias("x")).where("x.spans is not null")
    new = rows.select("blob", "x.kind", "x.version", "x.spans").dropDuplicates(["blob", "kind", "version"])
    new = common.written(new, "ledger")
    common.discard(chosen)
    return new, versions


def _count(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, n_<kind>..., spans array<struct<start,k,end,kind>>) for every path, by start and then kind."""
    place = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))])
    current = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    hits = ledger.where((F.size("spans") > 0) & (F.col("version") == current[F.col("kind")]))
    hits = hits.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), place[F.col("kind")].alias("k"), s["end"].alias("end"), F.col("kind").alias("kind"))).alias("s"))
    blobs = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set("s"))).alias("spans"))  # rows that repeat are one
    joined = versions.join(blobs, "blob", "left").withColumn("spans", F.coalesce("spans", F.array()))
    counts = [_count(r.kind).alias(f"n_{r.kind}") for r in rules]
    return joined.select("path", "blob", *counts, "spans")


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at a path; None where there is none yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(LEDGER).parquet(path)


def advance(paths: DataFrame, ledger_path: str, *, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of all `paths`, after the pairs of blob and rule version that the ledger lacks were scanned and appended to it."""
    spark = paths.sparkSession
    ledger = read_ledger(spark, ledger_path)
    new, versions = scan(paths, ledger, path_col=path_col, text_col=text_col, rules=rules)
    if ledger is None or not new.isEmpty():
        new.write.mode("append").parquet(ledger_path)
    common.discard(new)
    return findings(versions, read_ledger(spark, ledger_path), rules)


#: What the first of two runs knows of hexadecimal strings: an older version of the rule.
OLDER = (*RULES[:2], Rule("hex", r"[0-9a-f]{32,}", 0, 32, version=0))


def in_two_runs(docs: DataFrame, path: str) -> DataFrame:
    """Findings of all documents from a ledger that grew: an earlier state of the corpus, then the whole.

    The first run sees the blobs whose name begins with 0 to 7, with an older version of one rule.  The second sees everything,
    and scans what the ledger lacks: all rules on the other blobs, and on the known ones only the rule that changed.  So each
    pair of blob and rule version is scanned once, and the rest of the result comes from the ledger.
    """
    known = F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 1) < "8"
    advance(docs.where(known), path, rules=OLDER)
    return advance(docs, path)


def op10_blob_ledger(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = in_two_runs(docs, common.new_path(spark, "blob-ledger"))
    text = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    return found.select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def _kind_sql(kind: str, k: int, pattern: str, test: str) -> str:
    return f"""select doc_id, {k} k, '{kind}' kind, start, start + len(p) as "end" from (
  select doc_id, i, p, sum(len(p)) over (partition by doc_id order by i) - len(p) start from (
    select doc_id, unnest(parts) p, unnest(range(len(parts))) i from (
      select doc_id, string_split(regexp_replace(replace(coalesce(text, ''), chr(1), chr(2)), '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) parts from documents)))
where i % 2 = 1 and {test}"""


_ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SQL = f"""
with s as ({_kind_sql('assign', 0, _ASSIGN, f"len(regexp_extract(p, '{_ASSIGN}', 1)) >= 6")}
union all {_kind_sql('access', 1, 'AKIA[A-Z0-9]+', 'len(p) >= 20')}
union all {_kind_sql('hex', 2, '[0-9a-f]+', 'len(p) >= 24')}),
g as (select doc_id, count(*) filter (k = 0) a, count(*) filter (k = 1) b, count(*) filter (k = 2) c,
  string_agg(kind || ':' || cast(start as bigint) || ':' || cast("end" as bigint), ',' order by start, k) t from s group by doc_id)
select d.doc_id, coalesce(a, 0) n_assign, coalesce(b, 0) n_access, coalesce(c, 0) n_hex, sha256(coalesce(t, '')) base_sha256, coalesce(t, '') spans
from documents d left join g on d.doc_id = g.doc_id
"""
