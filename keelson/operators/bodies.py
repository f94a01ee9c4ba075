"""JSON bodies taken apart: every value with its pointer, repeated keys, and what each place of a body holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse
from .lineage import stored

#: Bytes of bodies or values that a task takes at most, and what one takes besides its texts.
BYTES, ROW = 1 << 26, 100


def escaped(key: Column) -> Column:
    """A key as a part of a JSON pointer."""
    return F.regexp_replace(F.regexp_replace(key, "~", "~0"), "/", "~1")


def json_type(kind: Column) -> Column:
    """The type of a variant, from its schema."""
    out = F.when(kind.startswith("OBJECT<"), "object").when(kind.startswith("ARRAY<"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean")
    return out.when(kind == "VOID", "null").otherwise("number")


def _parts(rows: DataFrame, *texts: str) -> int:
    """Tasks among which rows are dealt, so that none holds more than some BYTES of them, whatever the input's size."""
    held = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(ROW))
    return (rows.agg(F.sum(held)).first()[0] or 0) // BYTES + 1


def walk(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, pointer, place, type, value, empty) of every value in every body, the body itself at the empty pointer.

    ``place`` is the pointer with ``*`` for positions in arrays. Texts that are no JSON, or repeat a key, give
    no row. Each round takes all containers of one depth apart, so there are as many as bodies are deep; only
    containers go on to the next. Bodies are dealt out before, as what a task has of them it keeps in all rounds.
    """
    none = F.lit("")
    given = bodies.filter(F.col(body).isNotNull()).select(key, body)
    parts = max(bodies.sparkSession.sparkContext.defaultParallelism, _parts(given, body))
    level = given.repartition(parts, key, body).select(key, none.alias("pointer"), none.alias("place"), parse.strict_json(F.col(body)).alias("v")).filter("v IS NOT NULL")
    out = None
    while True:
        holds = F.col("type").isin("object", "array")
        level = level.withColumn("kind", F.schema_of_variant("v")).withColumn("type", json_type(F.col("kind"))).withColumn("value", F.when(~holds, F.col("v").cast("string")))
        # an array's schema doesn't tell whether it has nothing or only nulls
        empty = (F.coalesce("value", F.lit("x")) == "") | (F.col("kind") == "OBJECT<>") | ((F.col("kind") == "ARRAY<VOID>") & (F.to_json("v") == "[]"))
        # only containers are stored as variants, as each of those has all keys of its body
        level = stored(level.select(key, "pointer", "place", "type", "value", empty.alias("empty"), F.when(holds, F.col("v")).alias("v")))
        part = level.drop("v")
        out = part if out is None else out.union(part)
        parents = level.filter(holds).select(key, "pointer", "place", "v")
        if parents.isEmpty():
            return out
        name = escaped(F.col("its_key"))
        children = parents.lateralJoin(parents.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "its_key", "its_value"))
        level = children.select(key, F.concat("pointer", F.lit("/"), F.coalesce(name, F.col("pos").cast("string"))).alias("pointer"), F.concat("place", F.lit("/"), F.coalesce(name, F.lit("*"))).alias("place"), F.col("its_value").alias("v"))


def repeated_keys(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, pointer, name, times): keys that an object of a body has more than once.

    Only bodies that a strict reader refuses are looked at, as texts level by level; a text inside them that
    holds JSON itself is looked into as well.
    """
    none = F.lit("")
    level = bodies.filter(parse.strict_json(F.col(body)).isNull() & F.col(body).isNotNull()).select(key, none.alias("pointer"), F.trim(body).alias("text"))
    out = None
    while True:
        level = stored(level.filter(F.substring("text", 1, 1).isin("{", "[")))
        if level.isEmpty() and out is not None:
            return out
        inner = F.from_json("text", "map<string,string>")
        pairs = level.filter(F.col("text").startswith("{")).select(key, "pointer", F.posexplode(F.arrays_zip(F.map_keys(inner).alias("name"), F.map_values(inner).alias("text"))).alias("pos", "pair")).select(key, "pointer", "pair.name", "pair.text")
        many = pairs.groupBy(key, "pointer", "name").agg(F.count("*").alias("times")).filter("times > 1")
        out = many if out is None else out.union(many)
        items = level.filter(F.col("text").startswith("[")).select(key, "pointer", F.posexplode(F.from_json("text", "array<string>")).alias("pos", "text"))
        level = pairs.select(key, F.concat("pointer", F.lit("/"), escaped(F.col("name"))).alias("pointer"), F.trim("text").alias("text")).union(items.select(key, F.concat("pointer", F.lit("/"), F.col("pos").cast("string")), F.trim("text")))


def place_statistics(walked: DataFrame, key: str) -> DataFrame:
    """(place, type, n, bodies, empty, distinct): how often each place has a value of each type, in how many bodies, and with how many different values.

    Nothing is grouped before it is dealt by bodies to slabs of bounded size, each for a task of its own. There
    one row of each body and place stands for the body, and equal values, of which one may be nearly
    everywhere, become one row each before they meet those of other slabs.
    """
    parts = _parts(walked, "place", "value")
    dealt = F.pmod(F.coalesce(F.when(F.col(key).isNotNull(), F.xxhash64(key)), F.xxhash64("pointer", "value")), F.lit(parts)).cast("int")
    slabs = walked.select("place", "type", "value", "empty", F.col(key).alias("its_key"), dealt.alias("slab")).repartitionById(parts, "slab")
    stands = (F.row_number().over(Window.partitionBy("its_key", "place", "type", "slab").orderBy("its_key")) == 1) & F.col("its_key").isNotNull()
    held = slabs.withColumn("stands", stands).groupBy("slab", "place", "type", "value").agg(F.count("*").alias("n"), F.count_if("stands").alias("bodies"), F.count_if("empty").alias("empty"))
    sums = [F.sum(c).alias(c) for c in ("n", "bodies", "empty")]
    by_value = held.repartition(parts, "place", "type", "value").groupBy("place", "type", "value").agg(*sums)
    return by_value.groupBy("place", "type").agg(*sums, F.count("value").alias("distinct"))


def lacking(walked: DataFrame, key: str, places: list[str]) -> DataFrame:
    """(place, missing, null, empty): in how many bodies each place is not there, null or empty."""
    parts, keyed = _parts(walked, "place", "value"), walked.filter(F.col(key).isNotNull())
    by_body = keyed.filter(F.col("place").isin(places)).repartition(parts, "place", key).groupBy("place", key).agg(F.bool_or(F.col("type") == "null").alias("null"), F.bool_or("empty").alias("empty"))
    seen = by_body.groupBy("place").agg(F.count("*").alias("there"), F.count_if("null").alias("null"), F.count_if("empty").alias("empty"))
    whole = keyed.filter("pointer = ''").select(key).repartition(parts, key).distinct().agg(F.count("*").alias("whole"))
    asked = walked.sparkSession.createDataFrame([(p,) for p in places], "place string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return asked.join(seen, "place", "left").crossJoin(F.broadcast(whole)).select("place", (F.col("whole") - zero("there")).alias("missing"), zero("null").alias("null"), zero("empty").alias("empty"))
