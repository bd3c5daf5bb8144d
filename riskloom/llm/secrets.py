"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger is a table in a shared folder that
holds the findings of each (blob, rule version) pair that was ever scanned; the rule version is a digest of the
rules. A scan takes the distinct blobs of its input, leaves out the pairs the ledger has, scans the rest once
each, appends what it found and joins findings back to all paths (documents) by content address.

Whose ledger: a lasting folder, or one of its own for a single scan, which then starts empty. An append that is cut short
leaves whole files only, each row of which is true, so the ledger can be read on; pairs appended twice count once.

Null text: empty. Null doc_id is a path like any other; repeated rows are paths of their own. Other columns are
not read; their names don't matter.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import Scratch, fresh, map_arrow, texts_of

#: Setting of the session that names the folder of a lasting ledger.
LEDGER_DIR = "riskloom.secrets.ledger"
#: Findings that may be broadcast, by rows and by bytes of their spans.
BROADCAST_ROWS, BROADCAST_BYTES = 1 << 17, 1 << 24
#: Kinds in the order in which spans that start together are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "pem", "jwt")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )?PRIVATE KEY-----")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
RULES_VERSION = hashlib.sha256("\n".join([*KINDS, "assign of 6 and more", *(f"{r.pattern}/{r.flags}" for r in (_ASSIGN, _ACCESS, _HEX, _PEM, _JWT))]).encode()).hexdigest()[:16]
_WORDS = ("passw", "secret", "token", "api")


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) in code points, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "-----BEGIN" in text:
        out += [(m.start(), 3, m.end()) for m in _PEM.finditer(text)]
    if "eyJ" in text:
        out += [(m.start(), 4, m.end()) for m in _JWT.finditer(text)]
    return sorted(out)


def shown(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


LEDGER = "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
FOUND = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """Ledger rows of (blob, text)."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            rows = []
            for text in texts_of(batch.column(1)):
                found = spans(text)
                base = [x for x in found if x[1] < 3]
                rows.append((*(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(shown(base).encode()).hexdigest(), shown(found)))
            return {"blob": batch.column(0)} | dict(zip(FOUND, zip(*rows, strict=True), strict=True))

        return step

    return map_arrow(blobs.select("blob", "text"), make, LEDGER)


class Ledger:
    """Findings by blob and rule version, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or Scratch(spark, "secrets").path("ledger")).rstrip("/")

    @classmethod
    def of_session(cls, spark: SparkSession) -> Ledger:
        """The lasting ledger that the session names in ``riskloom.secrets.ledger``; else one of its own for this scan."""
        return cls(spark, spark.conf.get(LEDGER_DIR, None))

    def rows(self, rules: str) -> DataFrame | None:
        """What is known under these rules; None: nothing yet."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/rules={rules}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.schema(LEDGER).parquet(f"{self.folder}/rules={rules}")

    def append(self, found: DataFrame, rules: str) -> None:
        found.write.mode("append").parquet(f"{self.folder}/rules={rules}")


def scan(docs: DataFrame, ledger: Ledger | None = None, rules: str = RULES_VERSION) -> tuple[DataFrame, Ledger]:
    """(findings by doc_id, the ledger with all blobs of the documents)."""
    ledger = ledger or Ledger.of_session(docs.sparkSession)
    paths = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    hits = look_up(paths, ledger, rules)
    clean = F.sha2(F.lit(""), 256)
    out = paths.select("doc_id", "blob").join(hits, "blob", "left").select(
        "doc_id",
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in FOUND[:3]),
        F.coalesce("base_sha256", clean).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
    return out, ledger


def look_up(paths: DataFrame, ledger: Ledger, rules: str = RULES_VERSION) -> DataFrame:
    """Findings of the blobs of (blob, text) that have any, one row for a blob; unseen blobs are scanned and appended first."""
    scratch = Scratch(paths.sparkSession, "secrets")
    seen = ledger.rows(rules)
    unseen = paths if seen is None else paths.join(seen.select("blob"), "blob", "left_anti")
    # min of equal texts: one copy of each blob leaves a task, however many there are.
    blobs = unseen.groupBy("blob").agg(F.min("text").alias("text"))
    ledger.append(scan_blobs(blobs), rules)
    found = ledger.rows(rules).where("spans <> ''")
    if seen is None:  # all rows are of these documents, each once
        return scratch.cut(found, "hits")
    return scratch.cut(found.dropDuplicates(["blob"]).join(paths.select("blob"), "blob", "left_semi"), "hits")


def redact(docs: DataFrame, mark: str = "[secret]", ledger: Ledger | None = None) -> DataFrame:
    """The documents with every span found in their text replaced; n_chars follows where there is such a column.

    Findings come from the ledger of the distinct blobs and are joined back by content address; all columns stay,
    whatever they are called.
    """
    ledger = ledger or Ledger.of_session(docs.sparkSession)
    blob, spans_ = fresh(docs.columns, "blob", "spans")
    key = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    found = look_up(docs.select(key.alias("blob"), F.coalesce(docs["text"], F.lit("")).alias("text")), ledger)
    hits = found.select(F.col("blob").alias(blob), F.col("spans").alias(spans_))
    rows, size = hits.agg(F.count("*"), F.coalesce(F.sum(F.length(spans_)), F.lit(0))).first()
    # Few findings go to the texts; beyond the bound texts and findings meet in a shuffled join.
    small = rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    joined = docs.withColumn(blob, key).join(F.broadcast(hits) if small else hits, blob, "left")
    return _redacted(joined.select(*docs.columns, spans_), docs, mark)


def _redacted(joined: DataFrame, docs: DataFrame, mark: str) -> DataFrame:
    names = list(docs.columns)
    at, n_chars = names.index("text"), "n_chars" in names

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            cols = {c: batch.column(i) for i, c in enumerate(names)}
            found = batch.column(len(names)).to_pylist()
            if any(found):
                texts = batch.column(at).to_pylist()
                size = batch.column(names.index("n_chars")).to_pylist() if n_chars else None
                for i, listed in enumerate(found):
                    if listed:
                        texts[i] = replaced(texts[i], listed, mark)
                        if size:
                            size[i] = len(texts[i])
                cols["text"] = texts
                if size:
                    cols["n_chars"] = size
            return cols

        return step

    return map_arrow(joined, make, docs.schema)


def replaced(text: str, listed: str, mark: str) -> str:
    """The text with the listed spans, overlaps joined, replaced by the mark."""
    parts, at = [], 0
    for span in listed.split(","):
        _, a, b = span.split(":")
        a, b = int(a), int(b)
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]])
