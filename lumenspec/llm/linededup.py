"""Line deduplication across documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspec.llm.common import FEW_KEYS, let, saved

#: A line that stands at more places than this is broadcast to the table of lines rather than shuffled.
MANY = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\x0c\r"


def ascii_lower(x: Column) -> Column:
    """Lower-cases A-Z alone; translate() goes character by character, so pure ASCII takes the fast way."""
    return F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def _hash(line: Column, seed: str = "") -> Column:
    key = ascii_lower(stripped(line))
    return F.xxhash64(F.concat(F.lit(seed), key)) if seed else F.xxhash64(key)


def _without_gone(lines: Column) -> Column:
    """The lines at positions that are not in the column gone, in order; array_except() hashes plain numbers."""
    return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone"), lambda p: F.get(lines, p))


def free_name(docs: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with text_col rewritten, plus n_lines and n_dropped (long).

    A line's key is the line without blanks at its ends, A-Z lower-cased.
    Keys of at least ``min_chars`` code points found in at least ``min_docs``
    distinct ids lose all their lines except in the largest id that holds
    them. Other lines stay as they are, in order, joined by a newline. A null
    or empty text is one empty line (null stays null). Rows that repeat an id
    count as one document; rows with a null id count for no key and keep all
    lines. Other columns pass through, whatever their names; if n_lines or
    n_dropped is taken, the new column's name gets underscores at its end.

    Lines are told apart by 128 hash bits, rows by their id and a hash of
    their text. The exploded lines are a table of hashes and positions.
    Counting shuffles only hashes and ids and combines before the shuffle, so
    a line that most documents hold is no hot task. Lines that stand at very
    many places are so few that they are broadcast to the table of lines; the
    others are joined by shuffle. Texts are shuffled once, to meet the
    positions that they lose; time is linear in a text's lines.
    """
    # Names that no column of docs can have.
    plain = [f"_{k}" for k in range(len(docs.columns))]
    at = {c: plain[k] for k, c in enumerate(docs.columns)}
    d, id_, text = docs.toDF(*plain), F.col(at[id_col]), F.col(at[text_col])
    # The hash is a column before the text is exploded, so it isn't computed for each line anew.
    hashed = d.where(id_.isNotNull()).select(id_.alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    each = hashed.select("id", "row", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    long_lines = each.where(F.length(stripped(F.col("line"))) >= min_chars)
    held = saved(long_lines.select("id", "row", "pos", _hash(F.col("line")).alias("h1"), _hash(F.col("line"), "\n").alias("h2")), "lines")
    by_doc = held.groupBy("h1", "h2", "id").agg(F.count("*").alias("places"))
    counted = by_doc.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper"), F.sum("places").alias("places"))
    hot = saved(counted.where(F.col("n") >= min_docs), "hot")
    # At most FEW_KEYS lines can stand at more places than this.
    many = max(MANY, (hot.agg(F.sum("places")).first()[0] or 0) // FEW_KEYS)
    crowded, others = (hot.where(c).select("h1", "h2", "keeper") for c in (F.col("places") > many, F.col("places") <= many))
    drops = held.join(F.broadcast(crowded), ["h1", "h2"]).unionByName(held.join(others, ["h1", "h2"])).where("id <> keeper")
    gone = drops.groupBy("id", "row").agg(F.collect_set("pos").alias("gone"))
    met = d.join(gone, (id_ == F.col("id")) & (F.xxhash64(text) == F.col("row")), "left")
    new = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(let(lines_of(text), _without_gone), "\n"))
    dropped = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long")
    rest = [new.alias(c) if c == text_col else F.col(at[c]).alias(c) for c in docs.columns]
    return met.select(*rest, F.size(lines_of(text)).cast("long").alias(free_name(docs, "n_lines")), dropped.alias(free_name(docs, "n_dropped")))
