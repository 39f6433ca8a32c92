"""Entity resolution as a ladder of joins: the first rung that answers a surface decides it.

Rungs: exact id; ``self.x`` in its class (final); import alias; same module; re-export by a package
root; unique dotted suffix (final where several fit); unique leaf; unique folded leaf; documented
public parameter; the one candidate that no other calls; else the candidates; and builtin exceptions.
"""

from __future__ import annotations

import builtins
import inspect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The builtin exceptions that code raises by bare name: those of the interpreter that runs.
BUILTIN_EXCEPTIONS = tuple(
    sorted(
        name for name in dir(builtins) if inspect.isclass(
            getattr(builtins, name)
        ) and BaseException in getattr(builtins, name).__mro__
    )
)


def fold_name(s: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]", "")


def leaf(s: Column) -> Column:
    return F.substring_index(s, ".", -1)


def suffixes(ids: DataFrame) -> DataFrame:
    """``suffix, id``: proper dotted suffixes of at least two segments."""
    parts = F.split("id", r"\.")
    rows = ids.select("id", parts.alias("p")).where("size(p) > 2")
    return rows.select(
        "id", F.explode(F.expr("transform(sequence(2, size(p) - 1), n -> array_join(slice(p, -n, n), '.'))")).alias("suffix")
    )


def _unique(rows: DataFrame, key: str) -> DataFrame:
    """``key, n, id`` (the least), with sorted candidates."""
    return rows.groupBy(key).agg(
        F.count_distinct("id").alias("n"), F.min("id").alias("id"), F.array_sort(F.collect_set("id")).alias("candidates")
    )


def resolve(
    surfaces: DataFrame,
    universe: DataFrame,
    aliases: DataFrame | None = None,
    calls: DataFrame | None = None,
    public: DataFrame | None = None,
    documented: DataFrame | None = None,
) -> DataFrame:
    """``surface, module, cls, canonical_id, method, candidates`` of each distinct row of ``surfaces``.

    ``surfaces``: surface, module (null: none), cls (null: none). ``universe``: id. ``aliases``:
    module, local, target. ``calls``: src, dst. ``public``: id. ``documented``: function_id, param.
    """
    spark = surfaces.sparkSession
    empty = lambda s: spark.createDataFrame([], s)
    aliases = aliases if aliases is not None else empty("module string, local string, target string")
    ids = universe.select("id").distinct()
    asked = surfaces.select("surface", "module", "cls").distinct()
    key = [F.col("surface"), F.col("module"), F.col("cls")]

    def rung(n: int, method: str, rows: DataFrame) -> DataFrame:
        return rows.select(
            *key, F.lit(n).alias("rung"), F.lit(method).alias("method"), F.col("id").cast("string").alias("id"),
            F.col("candidates").cast("array<string>").alias("candidates")
        )

    none = F.array().cast("array<string>")
    one = lambda rows: rows.withColumn("candidates", none)
    exact = one(asked.join(ids.withColumn("surface", F.col("id")), "surface"))
    selfs = asked.where("cls is not null and surface like 'self.%'").withColumn(
        "want", F.concat_ws(".", "cls", F.expr("substr(surface, 6)"))
    )
    selfs = one(selfs.join(ids.select("id", F.col("id").alias("want")), "want", "left"))
    imported = one(
        asked.join(aliases.select("module", F.col("local").alias("surface"), F.col("target").alias("id")), ["module", "surface"])
    )
    local = one(
        asked.withColumn("want", F.concat_ws(".", "module", "surface")).where("module is not null").join(
            ids.select("id", F.col("id").alias("want")), "want"
        )
    )
    roots = aliases.where(~F.contains("module", F.lit("."))).select(
        F.concat_ws(".", "module", "local").alias("surface"), F.col("target").alias("id")
    )
    reexported = one(asked.join(roots, "surface"))
    dotted = asked.where(F.contains("surface", F.lit(".")))
    ends = suffixes(ids).withColumnRenamed("suffix", "surface").join(dotted.select("surface").distinct(), "surface", "left_semi")
    qualified = dotted.join(_unique(ends, "surface"), "surface")
    qualified = qualified.withColumn("id", F.when(F.col("n") == 1, F.col("id"))).withColumn(
        "candidates", F.when(F.col("n") > 1, F.col("candidates")).otherwise(none)
    )
    # The universe is cut down to the keys that are asked for before any index is built.
    wanted = lambda rows, keyed, key="key": rows.join(keyed.select(key).distinct(), key, "left_semi")
    leaves, folds = asked.withColumn("key", leaf(F.col("surface"))), asked.withColumn("key", fold_name(leaf(F.col("surface"))))
    by_leaf = _unique(wanted(ids.withColumn("key", leaf(F.col("id"))), leaves), "key")
    by_fold = _unique(wanted(ids.withColumn("key", fold_name(leaf(F.col("id")))), folds), "key")
    leaves, folds = leaves.join(by_leaf, "key"), folds.join(by_fold, "key")
    unique = lambda rows: one(rows.where("n = 1"))
    several = folds.where("n > 1")
    rungs = [
        rung(1, "exact", exact),
        rung(2, "self_reference", selfs),
        rung(3, "import_alias", imported),
        rung(4, "same_module", local),
        rung(5, "reexport", reexported),
        rung(6, "qualified", qualified),
        rung(7, "normalized", unique(leaves)),
        rung(8, "normalized", unique(folds)),
        rung(11, "ambiguous", several.withColumn("id", F.lit(None).cast("string"))),
        rung(12, "builtin", one(asked.where(F.col("surface").isin(*BUILTIN_EXCEPTIONS)).withColumn("id", F.concat(F.lit("builtins."), "surface")))),
    ]
    spread = several.select(*key, F.explode("candidates").alias("id"))
    owner = F.regexp_replace("id", r"\.[^.]*$", "")
    if public is not None and documented is not None:
        holder = F.regexp_replace(owner, r"\.[^.]*$", "")
        named = documented.select(F.concat_ws(".", "function_id", "param").alias("id"))
        shown = spread.join(named, "id", "left_semi").withColumn("o", owner).withColumn("h", holder)
        known = public.select(F.col("id").alias("o"), F.lit(True).alias("po")).distinct()
        shown = shown.join(known, "o", "left").join(
            known.select(F.col("o").alias("h"), F.col("po").alias("ph")), "h", "left"
        ).where("po or ph")
        rungs.append(
            rung(
                9, "public_api",
                one(shown.groupBy(*key).agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1"))
            )
        )
    if calls is not None:
        own = spread.withColumn("o", owner)
        others = own.alias("x").join(
            own.alias("y"), [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("surface", "module", "cls")]
        )
        called = others.join(
            calls.select(F.col("src"), F.col("dst")).distinct(),
            (F.col("y.o") == F.col("src")) & (F.col("x.o") == F.col("dst")) & (F.col("x.o") != F.col("y.o"))
        )
        called = called.select(*[F.col(f"x.{c}").alias(f"_{c}") for c in ("surface", "module", "cls", "id")]).distinct()
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("surface", "module", "cls", "id")]
        free = own.join(called, on, "left_anti").groupBy(*key).agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
        rungs.append(rung(10, "call_graph", one(free)))
    every = rungs[0]
    for r in rungs[1:]:
        every = every.unionAll(r)
    # Builtins come last but before nothing; a candidate list does not hide them unless it is the corpus's.
    first = every.groupBy(*key).agg(F.min_by(F.struct("method", "id", "candidates"), "rung").alias("r"))
    first = first.select(*[F.col(c).alias(f"_{c}") for c in ("surface", "module", "cls")], "r")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("surface", "module", "cls")]
    out = asked.join(first, on, "left")
    return out.select(
        "surface", "module", "cls", F.col("r.id").alias("canonical_id"),
        F.coalesce("r.method", F.lit("unresolved")).alias("method"), F.coalesce("r.candidates", none).alias("candidates")
    )


def unambiguous_index(sections: DataFrame) -> DataFrame:
    """``key, id`` of the folded breadcrumbs and leaves that name one id; sections without a name are left out."""
    rows = sections.where("section is not null")
    fold = lambda c: F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")
    keys = F.array_distinct(F.array(fold(F.col("section")), fold(F.substring_index("section", " > ", -1))))
    return rows.select(F.explode(keys).alias("key"), "id").where("key <> ''").groupBy("key").agg(
        F.count_distinct("id").alias("n"), F.min("id").alias("id")
    ).where("n = 1").select("key", "id")
