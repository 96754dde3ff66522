"""Problem 3: one surviving record of each group of duplicate records.

Each field is unpivoted to long rows, every row votes for its value in normal
form with the trust of its source times a decay of its age, the votes are
summed per value, and a pivot of ``max_by`` brings the winners back side by
side. Groups are told apart by a 16-byte digest of their key, values travel as
bytes, and both aggregations combine map-side, so a group holding a third of
all rows reaches its reducers as a few rows per distinct value.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from catalore.plans.runtime import cut_lineage, few

#: Half-lives that one bucket of votes spans; sums of 2^SPAN fit into a double with room to spare.
SPAN = 512
#: Half-lives by which a vote must lag behind another to be lost beside it in a double.
LOST = 60
#: Half-life of a vote in ``p3_survivors``: a year.
HALF_LIFE_S = 365 * 86_400.0
#: Half-life with which nothing outvotes what is a second newer.
NEWEST_S = 1e-3
#: Times are real from 1990 on, up to the day this library was exported; other libraries name theirs.
EARLIEST, EXPORTED = "1990-01-01T00:00:00Z", "2026-06-30T23:59:59.999999Z"
#: Sources whose trust is broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 100_000


@F.pandas_udf(StringType())
def _composed(paths: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no function for it."""
    return paths.map(lambda p: p if p is None or p.isascii() else unicodedata.normalize("NFC", p))


def place(path: Column) -> Column:
    """The place a path names, however it is spelled; letter case counts.

    Surrounding white space and quotes, ``file:`` schemes, percent escapes,
    backslashes, doubled slashes, ``.`` and ``..`` steps and decomposed letters
    are spelling. Null or blank paths name no place (null).
    """
    bare = F.regexp_replace(path, r"""^[\s"'\u00a0\ufeff]+|[\s"'\u00a0\ufeff]+$""", "")
    slashed = F.translate(bare, "\\", "/")
    local = F.regexp_replace(slashed, r"^(?i)file:(//(localhost)?(?=/))?", "")
    # stray percent signs and plus signs are themselves, not escapes
    safe = F.regexp_replace(F.regexp_replace(local, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    decoded = F.when(local.contains("%"), F.coalesce(F.try_url_decode(safe), local)).otherwise(local)
    steps = F.split(F.translate(decoded, "\\", "/"), "/")
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s.isin("", "."), done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))),
    )
    walked = F.when(decoded.rlike(r"//|/\.{1,2}(/|$)|^\.{1,2}(/|$)|/$"), F.concat(F.when(decoded.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))).otherwise(decoded)
    return F.when(F.length(bare) > 0, _composed(walked))


def moment(text: Column, exported: str = EXPORTED) -> Column:
    """The UTC timestamp of a time string in any of the usual notations, null unless real: from 1990 to ``exported``."""
    spelled = F.regexp_replace(F.trim(text), r"^(\d{4})[/.](\d\d)[/.](\d\d)", "$1-$2-$3")
    spelled = F.regexp_replace(spelled, r"^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d(:\d\d(\.\d+)?)?)\s*", "$1T$2")
    zoned = F.when(spelled.rlike(r"(?i)(z|utc|gmt|[+-]\d\d(:?\d\d)?)$") & spelled.contains("T"), spelled).otherwise(F.concat(spelled, F.when(spelled.contains("T"), "Z").otherwise("T00:00:00Z")))
    zoned = F.regexp_replace(F.regexp_replace(zoned, r"(T.*[+-]\d\d)(\d\d)$", "$1:$2"), r"(T.*[+-]\d\d)$", "$1:00")
    at = F.try_to_timestamp(zoned)
    real = spelled.rlike(r"^\d{4}-\d\d-\d\d") & (at >= F.lit(EARLIEST).cast("timestamp")) & (at <= F.lit(exported).cast("timestamp"))
    return F.when(real, at)


def whole_hash(text: Column) -> Column:
    """64 lower-case hex digits, or null if the hash is cut, marked, blank or of one repeated digit."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(text, r"""^[\s"']+|[\s"']+$""", "")), r"^(sha-?256[:=]|0x)\s*", "")
    return F.when(bare.rlike("^[0-9a-f]{64}$") & ~bare.rlike(r"^(.)\1{63}$"), bare)


def survivors(records: DataFrame, key: Column, fields: dict[str, Column], at: Column, trust: Column, half_life_s: float) -> DataFrame:
    """(first_id, records, one column per field): the best value of each field, as strings or bytes like the fields.

    A vote weighs ``trust * 2^(-age / half_life_s)``; records without a real
    time weigh as if older than all others. Ties go to the value seen last, then
    to the greater one. Records with a null key belong to no group; a field
    without any value is null; a null trust is none.

    Only ratios of votes matter, so ages count from a common origin: a weight
    is a mantissa and a bucket of SPAN half-lives, and votes are summed by
    value and bucket. A vote that is not lost beside the next bucket's is
    carried there, too, so the highest bucket alone decides. Both sums combine
    map-side and no group is ever gathered, however large.
    """
    names = list(fields)
    binary = [c.dataType.typeName() == "binary" for c in records.select(*[fields[n].alias(n) for n in names]).schema]
    rows = records.where(key.isNotNull()).select(
        "id",
        F.unhex(F.md5(key.cast("binary"))).alias("_key"),
        at.alias("_at"),
        F.coalesce(trust.cast("double"), F.lit(0.0)).alias("_trust"),
        *[v.cast("binary").alias(f"_{i}") for i, v in enumerate(fields.values())],
    )
    lives = F.unix_micros("_at") / F.lit(1e6 * half_life_s)
    bucket = F.floor(lives / SPAN).cast("long")
    weight = F.col("_trust") * F.pow(F.lit(2.0), lives - bucket * SPAN)
    dated = rows.select("*", F.coalesce(bucket, F.lit(-(1 << 60))).alias("_b"), F.coalesce(weight, F.col("_trust")).alias("_m"))
    # the first field that has a value also counts the record; one without any sends a row of its own
    first = F.lit(-1)
    for i in reversed(range(len(names))):
        first = F.when(F.col(f"_{i}").isNotNull(), i).otherwise(first)
    sent = F.array(
        F.struct(F.lit(-1).alias("f"), F.lit(None).cast("binary").alias("v"), (F.col("_first") < 0).alias("counts")),
        *[F.struct(F.lit(i).alias("f"), F.col(f"_{i}").alias("v"), (F.col("_first") == i).alias("counts")) for i in range(len(names))],
    )
    long = dated.withColumn("_first", first).select("id", "_key", F.unix_micros("_at").alias("us"), "_b", "_m", F.explode(sent).alias("x")).where("x.v is not null or x.counts")
    own = F.struct(F.col("_b").alias("b"), F.col("_m").alias("m"), F.col("x.counts").cast("int").alias("n"))
    carried = F.struct((F.col("_b") + 1).alias("b"), (F.col("_m") * 2.0**-SPAN).alias("m"), F.lit(0).alias("n"))
    heavy = (F.col("_m") >= 2.0 ** (SPAN - LOST)) & (F.col("x.f") >= 0)
    both = long.select("_key", "x.f", "x.v", "us", "id", F.explode(F.when(heavy, F.array(own, carried)).otherwise(F.array(own))).alias("w"))
    summed = both.groupBy("_key", "f", "v", "w.b").agg(F.sum("w.m").alias("m"), F.sum("w.n").alias("n"), F.max("us").alias("last"), F.min("id").alias("first"))
    vote = F.struct("b", "m", "last", "v")
    best = [F.max_by(F.when(F.col("f") == i, F.col("v")), F.when(F.col("f") == i, vote)).alias(f"_{i}") for i in range(len(names))]
    each = summed.groupBy("_key").agg(F.min("first").alias("first_id"), F.sum("n").alias("records"), *best)
    return each.select("first_id", "records", *[(F.col(f"_{i}") if binary[i] else F.col(f"_{i}").cast("string")).alias(n) for i, n in enumerate(names)])


def source_trust(files: DataFrame, exported: str = EXPORTED) -> DataFrame:
    """(scan_id, trust): how far each scan's records can be trusted, from 0 to 1.

    The share of a scan's records that have a genuine hash and a real time,
    counted as if one more of each kind had been seen. Records without a scan
    have a share of their own.
    """
    whole = whole_hash(F.col("sha256")).isNotNull() & moment(F.col("last_modified"), exported).isNotNull()
    each = files.groupBy("scan_id").agg(F.sum(whole.cast("long")).alias("whole"), F.count(F.lit(1)).alias("n"))
    return each.select("scan_id", ((F.col("whole") + 1) / (F.col("n") + 2)).alias("trust"))


def file_survivors(files: DataFrame, half_life_s: float, trust: Column, with_path: bool, exported: str = EXPORTED) -> DataFrame:
    """One row per file of ``files``: first_id, records, sha256, last_modified, and path and filename if wanted.

    A path votes in normal form, on which all records of a file agree; the
    filename is its last step. Times come without fractions.
    """
    at = moment(F.col("last_modified"), exported)
    fields = {"sha256": F.unhex(whole_hash(F.col("sha256"))), "last_modified": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")}
    if with_path:
        fields = {"path": F.col("_place")} | fields
    found = survivors(files.withColumn("_place", place(F.col("path"))), F.col("_place"), fields, at, trust, half_life_s)
    found = found.withColumn("sha256", F.lower(F.hex("sha256")))
    return found.withColumn("filename", F.element_at(F.split("path", "/"), -1)) if with_path else found


def p3_found(files: DataFrame, exported: str = EXPORTED) -> DataFrame:
    """Files recorded by two or more rows, with their best hash and time.

    The newest record decides by definition, so its vote has a half-life of a
    millisecond and older ones only break ties; of records of one time those
    marked available weigh a little more.
    """
    trust = F.when(F.col("available"), 1.0).otherwise(0.999)
    return file_survivors(files, NEWEST_S, trust, False, exported).where("records > 1").select("first_id", "sha256", "last_modified")


def p3_survivors(files: DataFrame, half_life_s: float = HALF_LIFE_S, trusts: DataFrame | None = None, exported: str = EXPORTED) -> DataFrame:
    """The surviving record of every file; agreeing records of trusted sources may outvote a newer one.

    ``trusts`` (scan_id, trust) names the trust of each source, one row each; by
    default it is ``source_trust``. A source it does not name counts nothing
    beside others.
    """
    trusts = cut_lineage((source_trust(files, exported) if trusts is None else trusts).select(F.col("scan_id").alias("_scan"), F.col("trust").alias("_source_trust")))
    trusts = F.broadcast(trusts) if few(trusts, BROADCAST_ROWS) else trusts
    known = files.join(trusts, files["scan_id"].eqNullSafe(trusts["_scan"]), "left")
    return file_survivors(known, half_life_s, F.col("_source_trust"), True, exported)
