"""Protocol files read record by record: what cannot be read is set aside with its place and the reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.operators.common import bound, pinned, running
from rostrum.session import materialize
from rostrum.sources.readers import PROTOCOL_SCHEMA, protocol_columns

#: Where a record begins. Quotes inside a JSON string are escaped, so this does not occur within a text.
RECORD_START = r'\{\s*"(?:data|fullText)"\s*:'
#: Characters of a broken record that are kept for review.
KEPT_CHARS = 200

#: Why a record is set aside.
MALFORMED, NO_ID, NO_TEXT, NO_RECORD = "malformed", "no id", "no text", "no record"


@dataclass(frozen=True)
class Records:
    """Good rows with the columns of ``read_protocols``, and ``(file, offset, reason, raw)`` of the others."""

    good: DataFrame
    quarantine: DataFrame


def _pieces(text: Column) -> Column:
    """``(offset, piece)`` of a text cut in front of every record; offsets count characters."""

    def placed(pieces: Column) -> Column:
        sizes = F.transform(pieces, F.length)
        return bound(running(sizes, lambda a, b: a + b, F.lit(0), "int"), lambda at: F.transform(pieces, lambda p, i: F.struct(F.get(at, i).alias("offset"), p.alias("piece"))))

    return bound(F.split(text, f"(?={RECORD_START})"), placed)


def read_records(spark: SparkSession, path: str, lines: bool = False) -> Records:
    """Records of JSON files that hold a document, an array of documents, or documents one after another.

    A file is cut where a record begins and each record is parsed on its own, so a broken record costs its neighbours
    nothing. Set aside are records that are no complete JSON object (``malformed``), those whose id is no number
    (``no id``), those without text (``no text``), and whatever else precedes the first record of a file (``no record``).
    With ``lines`` every line is a record: files of any size are then split among tasks, and offsets are null. Both
    results are read from one pass over the files, kept on reliable storage. An empty folder of files gives no rows.
    """
    source = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("_text"))
    if lines:
        rows = source.select("file", F.lit(None).cast("int").alias("offset"), F.col("_text").alias("piece"))
    else:
        rows = source.select("file", F.inline(_pieces(F.col("_text"))))
    begins = F.col("piece").rlike(f"^{RECORD_START}")
    # what separates records in an array belongs to none of them
    body = F.when(begins, F.regexp_replace("piece", r"[\s,\]]+$", ""))
    schema = f"{PROTOCOL_SCHEMA}, _bad string"
    parsed = pinned(rows, body=body)
    # one record only: what follows a complete object must be nothing
    parsed = pinned(parsed, r=F.from_json("body", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    whole = F.col("body").endswith("}")
    reason = (
        F.when(F.col("body").isNull() & F.col("piece").rlike(r"^[\s\[\],]*$"), F.lit(None).cast("string"))
        .when(F.col("body").isNull(), NO_RECORD if not lines else MALFORMED)
        .when(F.col("r._bad").isNotNull() | ~whole, MALFORMED)
        .when(F.col("r.data.id").try_cast("long").isNull(), NO_ID)
        .when(F.coalesce(F.col("r.fullText"), F.lit("")) == "", NO_TEXT)
    )
    kept = materialize(pinned(parsed, reason=reason).filter("body IS NOT NULL OR reason IS NOT NULL").select("file", "offset", "r", "reason", F.substring("piece", 1, KEPT_CHARS).alias("raw")))
    good = protocol_columns(kept.filter("reason IS NULL").select("r.*"))
    return Records(good, kept.filter("reason IS NOT NULL").select("file", "offset", "reason", "raw"))
