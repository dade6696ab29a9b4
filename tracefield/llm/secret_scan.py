"""Secret scans over an incremental ledger of blobs.

Every version of a text is a blob, known by the SHA-256 of its UTF-8 bytes.
The ledger holds, for each blob and version of the rules under which it was
scanned, the spans found. A scan takes only those pairs of blob and rule
version that the ledger lacks, adds them, and joins the findings back to every
path (doc_id) that has the blob. DataFrame functions only.

Spans are counted in code points, the end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import work_dir
from .skew import join_one


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` of which ``group`` has ``least`` characters or more; ``hint``: a string that texts with a match contain."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hint: str = ""


# The patterns that the findings are defined by. A run of hex digits or of key
# characters that is too short holds no long enough one, so their lengths stand in the pattern.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", hint="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
)
RULES = BASE + MORE
#: To be raised with every change of RULES: blobs are then scanned anew.
RULES_VERSION = "1"

LEDGER = "blob string, rules string, spans array<struct<start:int,rank:int,kind:string,end:int>>"
_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _spans(text: Column, rank: int, rule: Rule) -> Column:
    """The spans of one rule: the pieces between matches and the matches take turns, so lengths give places."""
    p = F.lit(rule.pattern)
    turns = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"), F.regexp_extract_all(text, p, F.lit(rule.group)).alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.cast("int").alias("end"))
        return F.struct(end.cast("int").alias("at"), F.when(F.length(x["value"]) >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"]).cast(_SPANS).alias("out"))

    empty = F.array().cast(_SPANS)
    # The last gap has no match after it.
    found = F.aggregate(F.slice(turns, 1, F.size(turns) - 1), F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    has = text.rlike(rule.pattern)
    return F.when(F.contains(text, F.lit(rule.hint)) & has if rule.hint else has, found).otherwise(empty)


def find_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text, by start and then in the order of the rules."""
    return F.array_sort(F.flatten(F.array(*(_spans(text, i, r) for i, r in enumerate(rules)))))


def blobs(docs: DataFrame) -> DataFrame:
    """doc_id, text and blob of every row; a null text is the empty blob."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("blob"))


def new_ledger(spark: SparkSession) -> str:
    """An empty ledger in the shared folder."""
    path = work_dir(spark, "ledger")
    spark.createDataFrame([], LEDGER).write.parquet(path)
    return path


def update_ledger(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, version: str = RULES_VERSION) -> None:
    """Scan what ``docs`` has that the ledger lacks under this rule version, and append it.

    One row of each new blob is scanned: that with the least doc_id. Running it
    again adds nothing.
    """
    spark = docs.sparkSession
    rows = blobs(docs)
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    known = spark.read.schema(LEDGER).parquet(ledger).filter(F.col("rules") == version).select("blob")
    unseen = rows.groupBy("blob").agg(F.min(key).alias("key")).join(known, "blob", "left_anti")
    # Joined by document and not by blob, so that the copies of one text don't meet in one task.
    todo = rows.withColumn("key", key).join(unseen.select("key", F.col("blob").alias("new")), "key").filter(F.col("blob") == F.col("new"))
    found = todo.select("blob", F.lit(version).alias("rules"), find_spans(F.col("text"), rules).alias("spans")).dropDuplicates(["blob"])
    found.write.mode("append").parquet(ledger)


def _found(spark: SparkSession, ledger: str, version: str) -> DataFrame:
    """blob and spans of the blobs with any; one row each, though two scans at a time may both have added it."""
    held = spark.read.schema(LEDGER).parquet(ledger).filter((F.col("rules") == version) & (F.size("spans") > 0))
    return held.select("blob", "spans").dropDuplicates(["blob"])


def findings(docs: DataFrame, ledger: str, version: str = RULES_VERSION) -> DataFrame:
    """doc_id, blob and spans (empty where none) of every row of ``docs``."""
    return join_one(blobs(docs).select("doc_id", "blob"), _found(docs.sparkSession, ledger, version), ["blob"], "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """Find secrets in every text; one row per row of ``docs``.

    Null and empty texts have none. Repeated rows each get their row.
    """
    spark = docs.sparkSession
    ledger = ledger or new_ledger(spark)
    update_ledger(docs, ledger)
    spans = F.col("spans")
    of = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda x: x["rank"] < len(BASE))
    return findings(docs, ledger).select("doc_id", *(of(r.kind) for r in BASE), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def redact(docs: DataFrame, ledger: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span found replaced by ``mark`` (overlapping spans by one), n_chars following; other rows and columns stay."""
    ledger = ledger or new_ledger(docs.sparkSession)
    update_ledger(docs, ledger)
    held = _found(docs.sparkSession, ledger, RULES_VERSION).select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    text = F.col("text")

    def step(acc: Column, x: Column) -> Column:
        # Only what lies between the end so far and this span is kept; a span inside an earlier one adds nothing.
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        more = F.concat(acc["out"], gap, F.when((x["start"] >= acc["at"]) | (acc["at"] == 0), F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), more.alias("out"))

    done = F.aggregate(F.col("_spans"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    clean = F.when(F.col("_spans").isNotNull(), F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)
    out = join_one(docs.withColumn("_blob", F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), held, ["_blob"], "left").withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
