"""Product families: grouping by base name, variant dimensions, scores, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as t
from . import cleaning

c = F.col
P = {k: "(?U)" + v for k, v in fixed.DIMENSION_PATTERNS.items()}
_COLOUR = rf"(?U)\b({'|'.join(fixed.COLOURS)})\b"
DIMS = tuple(fixed.DIMENSION_NAMES)


def base_name(name: Column) -> Column:
    """Lower case, without what varies in a family: sizes, measures, sides, colours, filler words, and a number at the end."""
    x = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    fillers = rf"(?U)\b({'|'.join(fixed.STRIP_TOKENS)})\b"
    for pattern in (*(P[k] for k in ("size", "number", "gauge", "dimension", "volume", "ch", "suture", "side")), _COLOUR, fillers, P["length"]):
        x = F.regexp_replace(x, pattern, "")
    x = F.regexp_replace(F.regexp_replace(x, r"(?U)(?<!\w)[,;/\-–—]+(?!\w)", " "), r"(?U)(?<=\w)-(?=\w)", "")
    return F.regexp_replace(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), r"(?U)\s+\d+$", "")


def dimensions(name: Column, specification: Column, details: Column | None = None) -> dict[str, Column]:
    """The dimensions in which a product can vary: its name before its specification before its details; null where there is none."""
    texts = [F.lower(F.coalesce(x, F.lit(""))) for x in (name, specification)]

    def found(k: str, x: Column, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(x, P[k], group), F.lit(""))

    def measure(k: str, x: Column) -> Column:
        return F.when(found(k, x).isNotNull(), F.concat(found(k, x), F.regexp_extract(x, P[k], 2)))

    def detail(k: str) -> Column:
        if details is None or k not in fixed.DIMENSION_KEYS:
            return F.lit(None).cast("string")
        held = F.filter(F.map_entries(details), lambda e: F.lower(F.trim(e.key)).rlike("(?U)" + fixed.DIMENSION_KEYS[k]) & (F.trim(e.value) != ""))
        return F.trim(F.get(held, F.lit(0)).value)

    sizes = F.coalesce(*[v for x in texts for v in (F.upper(found("size", x)), found("number", x))])
    crossed = [measure("dimension", x) for x in texts]
    lengths = F.when(crossed[0].isNull(), F.coalesce(measure("length", texts[0]), F.when(crossed[1].isNull(), measure("length", texts[1]))))
    own = {
        "size": sizes, "gauge": F.coalesce(*[F.concat(found("gauge", x), F.lit("G")) for x in texts]), "dimension": F.coalesce(*crossed),
        "volume": F.coalesce(*[measure("volume", x) for x in texts]), "ch": F.coalesce(*[F.concat(F.lit("CH"), found("ch", x)) for x in texts]),
        "suture": F.coalesce(*[found("suture", x) for x in texts]), "length": lengths,
        "colour": F.initcap(F.coalesce(*[F.nullif(F.regexp_extract(x, _COLOUR, 1), F.lit("")) for x in texts])), "side": F.initcap(F.coalesce(*[found("side", x) for x in texts])),
    }
    return {k: F.coalesce(own[k], detail(k)) if k in own else detail(k) for k in DIMS}


def safety(x: Column) -> dict[str, Column]:
    """Safety attributes named in a text; absent is unknown."""
    y = F.lower(F.coalesce(x, F.lit("")))
    return {
        "sterility": F.when(y.rlike("usteril|u-steril|ikke[- ]steril|non[- ]steril"), "Usteril").when(y.rlike("steril"), "Steril"),
        "latex": F.when(y.rlike("latex[- ]?fri|latex[- ]?free|uten latex"), "Lateksfri").when(F.contains(y, F.lit("latex")), "Latex"),
        "use": F.when(y.rlike("engangs|disposable|single[- ]use"), "Engangs").when(y.rlike("flergangs|reusable|gjenbruk"), "Flergangs"),
        "material": F.when(F.contains(y, F.lit("nitril")), "Nitril").when(F.contains(y, F.lit("vinyl")), "Vinyl").when(y.rlike("pudder[- ]?fri|powder[- ]?free"), "Pudderfri"),
    }


def records(products: DataFrame) -> DataFrame:
    """key, article_number, name, brand, category, base, group_key and one column a dimension. Rows without a base name are out."""
    brand = t.effective_brand(c("brand"), c("supplier"))
    out = products.select("key", "article_number", c("family_name").alias("name"), brand.alias("brand"), c("family_category").alias("category"), c("family_specification").alias("specification"), "details")
    out = cleaning.once(out, {"base": base_name(c("name"))}).filter("base <> ''")
    out = out.withColumn("group_key", F.concat_ws("||", F.when(c("brand") == "", "_unknown_").otherwise(c("brand")), c("base")))
    return cleaning.once(out, {f"dim_{k}": v for k, v in dimensions(c("name"), c("specification"), c("details")).items()})


def groups(recs: DataFrame, least: int = 2) -> DataFrame:
    """One row a candidate group: counts, score (hundredths), varying dimensions, mother and id. Only counts, minima and maxima are gathered.

    Whether a column has no, one or more values is told by its least and greatest one, so no distinct count spreads the rows.
    """
    varied = {"n_categories": "category", **{f"distinct_{d}": f"dim_{d}" for d in DIMS}}
    has_dim = F.coalesce(*[c(f"dim_{d}") for d in DIMS]).isNotNull()
    found = recs.groupBy("group_key").agg(
        F.count("*").alias("n"), F.min("brand").alias("brand"), F.min("base").alias("base"), F.min("key").alias("first_key"),
        F.count_if(has_dim).alias("n_with_dims"), F.count_if(~has_dim).alias("n_without"), F.min(F.when(~has_dim, c("key"))).alias("without_key"),
        *[F.min(F.contains(F.lower("name"), F.lit(k))).alias(f"typed_{i}") for i, k in enumerate(fixed.TYPE_KEYWORDS)],
        *[F.count(f"dim_{d}").alias(f"n_{d}") for d in DIMS], *[F.struct(F.min(x).alias("least"), F.max(x).alias("greatest")).alias(f"_{k}") for k, x in varied.items()],
    ).filter(c("n") >= least)
    several = lambda x: F.when(x["least"].isNull(), 0).when(x["least"] == x["greatest"], 1).otherwise(2)
    found = cleaning.once(found, {k: several(c(f"_{k}")) for k in varied})
    common, typed = F.greatest(*[c(f"n_{d}") for d in DIMS]), F.greatest(*[c(f"typed_{i}") for i in range(len(fixed.TYPE_KEYWORDS))])
    raw = (
        F.lit(30) + F.when(c("brand") == "", -10).otherwise(20) + F.when(c("n_with_dims") >= 2, 25).when(c("n_with_dims") == 1, 5).otherwise(0) + F.when(typed, 15).otherwise(0)
        + F.when(c("n_categories") == 1, 10).when(c("n_categories") > 1, -5).otherwise(0) + F.when(c("n") > 15, -5).when(c("n") >= 3, 5).otherwise(0) + F.when(common * 100 >= c("n") * 60, 10).otherwise(0)
    )
    found = cleaning.once(found, {"_raw": F.least(F.greatest(raw, F.lit(0)), F.lit(100)), "_typed": typed})
    raw, typed = c("_raw"), c("_typed")
    # dimensions count only if two members have some
    few = c("n_with_dims") < 2
    capped = F.when(few, F.least(raw, F.lit(40))).otherwise(raw)
    # without a brand: a lower cap, then 0.85 of it
    low = F.least(capped, F.when(few, 30).when(~typed, 40).otherwise(100))
    reduced = F.floor((low * 85 + 50) / 100)
    for x, y in fixed.REDUCED_HALVES.items():
        reduced = F.when(low == x, y).otherwise(reduced)
    capped = F.when(c("brand") == "", reduced).otherwise(capped)
    found = cleaning.once(found, {"score": capped.cast("long")})
    varying = F.filter(F.array(*[F.when(c(f"distinct_{d}") >= 2, name) for d, name in fixed.DIMENSION_NAMES.items()]), lambda x: x.isNotNull())
    return found.select(
        F.concat(F.lit("FAM-"), F.substring(F.sha2("group_key", 256), 1, 16)).alias("family_id"), "group_key", "n", "score", F.array_join(varying, ",").alias("varying"),
        ((c("score") < 65) | (F.size(varying) == 0)).alias("needs_review"), F.when(c("n_without") == 1, c("without_key")).alias("mother_key"), "first_key",
    )


def ordered(fams: DataFrame, least: int = 30) -> DataFrame:
    """Families of a sufficient score with their places: by score, then by size, then by their first member."""
    kept = fams.filter(c("score") >= least)
    reason = F.when(c("score") >= 70, "Sterk familiegruppe — høy likhet og konsistente varianter").when(c("score") >= 50, "Sannsynlig familie — moderat likhet").when(c("score") >= 30, "Mulig familie — krever manuell gjennomgang")
    return kept.orderBy(F.desc("score"), F.desc("n"), "first_key").select("family_id", "group_key", "n", "score", "first_key", reason.alias("reason"))


def members(recs: DataFrame, fams: DataFrame, least: int = 30) -> DataFrame:
    """Every record with its family and role: mother, child, or standalone."""
    kept = fams.filter(c("score") >= least).select("group_key", "family_id", "mother_key")
    role = F.when(c("family_id").isNull(), "standalone").when(c("key") == c("mother_key"), "mother").otherwise("child")
    return recs.join(kept, "group_key", "left").select("key", "family_id", role.alias("role"))


def family_names(recs: DataFrame) -> DataFrame:
    """The most frequent name of each group, the first seen of equals."""
    counted = recs.groupBy("group_key", "name").agg(F.count("*").alias("uses"), F.min("key").alias("first_key"))
    rank = F.row_number().over(W.partitionBy("group_key").orderBy(F.desc("uses"), "first_key"))
    return counted.withColumn("rank", rank).filter("rank = 1").select("group_key", c("name").alias("family_name"), "uses")


def replay(mem: DataFrame, log: DataFrame) -> DataFrame:
    """Members after a log of moves (seq, key, target, undone): the last one that wasn't undone holds."""
    last = log.filter(~c("undone")).groupBy("key").agg(F.max_by("target", "seq").alias("target"))
    return mem.join(last, "key", "left").select("key", F.coalesce("target", "family_id").alias("family_id"), c("target").isNotNull().alias("moved"))


def merged(mem: DataFrame, merges: DataFrame) -> DataFrame:
    """Members (key, family_id) after merges (source, target): those of a source are the target's, and marked as moved. Chains are followed by later merges."""
    into = merges.select(c("source").alias("family_id"), "target")
    return mem.join(into, "family_id", "left").select("key", F.coalesce("target", "family_id").alias("family_id"), c("target").isNotNull().alias("moved"))


def split_off(mem: DataFrame, picked: DataFrame) -> DataFrame:
    """Members after splits: of each family the picked keys (key) form a new one, unless they are all of it, which is refused."""
    marked = mem.join(picked.select("key", F.lit(True).alias("out")), "key", "left").withColumn("out", F.coalesce("out", F.lit(False)))
    sums = marked.filter("family_id is not null").groupBy("family_id").agg(F.count_if("out").alias("n_out"), F.count("*").alias("n"), F.min(F.when(c("out"), c("key"))).alias("first_out"))
    new = F.concat(F.lit("FAM-"), F.substring(F.sha2(F.concat(F.lit("manual-split-"), c("family_id"), F.lit("-"), c("first_out").cast("string")), 256), 1, 16))
    moved = c("out") & (c("n_out") < c("n"))
    return marked.join(sums, "family_id", "left").select("key", F.when(moved, new).otherwise(c("family_id")).alias("family_id"), F.coalesce(moved, F.lit(False)).alias("moved"))


def without_last(log: DataFrame) -> DataFrame:
    """A log of overrides (seq, ...) after its last one is undone."""
    last = log.agg(F.max("seq").alias("last"))
    return log.join(F.broadcast(last), c("seq") == c("last"), "left_anti")
