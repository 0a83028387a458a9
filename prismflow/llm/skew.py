"""Joins by keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismflow import storage

#: Rows of one key that one task may take, and the most keys that can be listed as frequent.
FAN, MOST = 100_000, 2048
#: Bits of the filter that thins out rows before a join.
FILTER_BITS = 1 << 23


class Heavy:
    """The keys that more than ``fan`` of ``rows`` share; ``n`` is the number of rows, or a bound of it.

    A key is listed only if it has more than n / ``MOST`` rows, so there are fewer than ``MOST`` and the list may be
    broadcast. With ``n`` up to ``fan`` there is none, and nothing is counted.
    """

    def __init__(self, rows: DataFrame, keys: list[str], n: int, fan: int | None = None):
        self.keys, self.table = keys, None
        fan = max(fan or FAN, n // MOST)
        if n > fan:
            often = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > fan)
            found = storage.cut(often.select(*keys, F.ceil(F.col("_n") / fan).cast("int").alias("_salts")))
            if found.limit(1).count():
                self.table = found
            else:
                storage.drop(found)

    def join(self, rows: DataFrame, table: DataFrame, by: str, how: str = "inner") -> DataFrame:
        """``rows`` joined with ``table`` by the keys; rows of frequent keys are dealt by the hash of ``by`` and ``table``'s rows repeated."""
        if self.table is None:
            return rows.join(table, self.keys, how)
        heavy, salts = F.broadcast(self.table), F.coalesce("_salts", F.lit(1))
        dealt = rows.join(heavy, self.keys, "left").withColumn("_salt", F.pmod(F.xxhash64(F.lit(17), by), salts).cast("int")).drop("_salts")
        copies = table.join(heavy, self.keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
        return dealt.join(copies, [*self.keys, "_salt"], how).drop("_salt")


def lookup(rows: DataFrame, table: DataFrame, key: str, by: str, n: int, how: str = "inner", fan: int | None = None) -> DataFrame:
    """``rows`` joined with ``table``, safe for frequent values of ``key``."""
    return Heavy(rows, [key], n, fan).join(rows, table, by, how)


def possible(rows: DataFrame, wanted: DataFrame, key: str, keep: bool = False) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted``: a one-hash Bloom filter of ``FILTER_BITS``
    bits, handed out as at most ``FILTER_BITS`` / 64 words whatever the input, so that few rows are shuffled.
    With ``keep`` all rows stay and column ``may`` tells them apart."""
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    words = wanted.select(bit.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_bit & 63 as int)))").alias("_bits"))
    marked = rows.withColumn("_bit", bit).withColumn("_word", F.shiftright("_bit", 6)).join(F.broadcast(words), "_word", "left")
    may = F.coalesce(F.expr("(shiftright(_bits, cast(_bit & 63 as int)) & 1) = 1"), F.lit(False))
    if keep:
        return marked.withColumn("may", may).select(*rows.columns, "may")
    return marked.where(may).select(rows.columns)
