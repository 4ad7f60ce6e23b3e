"""What a result was made from, what changed since, and gates that fail closed."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(rows, digest) of a table's content whatever its order: the count, and the sum and the
    exclusive or of the rows' hashes.  One pass, no sort, nothing gathered."""
    names = sorted(columns or df.columns)
    # hash of the text of each field, nulls told from blanks
    text = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.to_json(F.struct(F.col(f"`{c}`").alias("v")))), F.lit("-")) for c in names])
    row = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")
    one = df.select(row.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("s"), F.coalesce(F.bit_xor(F.col("h").cast("long")), F.lit(0)).cast("string").alias("x"))
    return one.select("rows", F.sha2(F.concat_ws("|", F.lit(",".join(names)), F.col("rows").cast("string"), "s", "x"), 256).alias("digest"))


def contract_hash(parameters: dict) -> str:
    """The hash of everything a stored result depends on, keys in order."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(key, field, old, new) of fields that differ for keys of both tables; numbers differ beyond
    the tolerance, a null and a value always."""
    a = old.select(key, *[F.col(c).alias(f"_a{i}") for i, c in enumerate(columns)])
    b = new.select(key, *[F.col(c).alias(f"_b{i}") for i, c in enumerate(columns)])
    kinds = dict(old.dtypes)

    def differ(i: int, c: str) -> Column:
        x, y = F.col(f"_a{i}"), F.col(f"_b{i}")
        if kinds[c] in ("double", "float"):
            return F.coalesce(F.abs(x - y) > tolerance, x.isNull() != y.isNull())
        return ~x.eqNullSafe(y)

    each = [F.when(differ(i, c), F.struct(F.lit(c).alias("field"), F.col(f"_a{i}").cast("string").alias("old"), F.col(f"_b{i}").cast("string").alias("new"))) for i, c in enumerate(columns)]
    return a.join(b, key).select(key, F.explode(F.array_compact(F.array(*each))).alias("d")).select(key, "d.*")


def first_failure(rules: dict[str, Column]) -> Column:
    """The name of the first rule, in order, that doesn't hold; null where all hold."""
    return F.coalesce(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The table, failing as it is read where a row breaks a rule."""
    failure = first_failure(rules)
    return df.filter(F.when(failure.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("broken rule: "), failure))))


def expand(pages: DataFrame, url: str, links: str) -> DataFrame:
    """(url, found_on, pages): the addresses that pages link to and that are no pages yet."""
    linked = pages.select(F.col(url).alias("_from"), F.explode(links).alias("url")).groupBy("url").agg(F.min("_from").alias("found_on"), F.count_distinct("_from").alias("pages"))
    known = pages.select(F.col(url).alias("url")).distinct()
    return linked.join(known, "url", "left_anti")
