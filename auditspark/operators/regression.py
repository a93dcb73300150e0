"""Least squares with HC3 standard errors for the label coefficient.

All regressors are discrete, so rows with equal regressors share one leverage
and one fitted value. The data is therefore reduced once to design cells
(count, mean and spread of y): the cells are sufficient for coefficients,
leverages and the HC3 sum, and every later pass reads cells only.

One factor (the one with most levels) is absorbed by within-level demeaning
instead of dummy columns; the matrix that must be inverted holds the label, the
numeric controls and the levels of the remaining factors. It is kept in tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dist import p_normal
from ..session import materialize
from .joins import lookup_join

LABEL = "label"
BLOCK = 128  # side of a tile of the cross-product matrix
GROUP_ENTRIES = 1 << 20  # vector entries multiplied with a tile in one group
RANK_CUT = 1e-9  # least unexplained share of an independent regressor
VARIES = 1e-10  # least share of a regressor's square sum within absorbed levels
Z_95 = 1.959963984540054  # 97.5 % point of the standard normal (fixed value)


def design_cells(df: DataFrame, key: str, y: str, label: str, absorb: str, factors: list[str], numerics: list[str]) -> DataFrame:
    """Count, mean and centred sum of squares of y per distinct design row.

    Missing y, label or numeric values drop the row; a missing factor is a
    level of its own.
    """
    level = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f)
    design = df.select(
        key,
        F.col(y).cast("double").alias("__y"),
        F.col(label).cast("double").alias(LABEL),
        *[level(f) for f in [absorb, *factors]],
        *[F.col(x).cast("double").alias(x) for x in numerics],
    ).dropna(subset=["__y", LABEL, *numerics])
    return design.groupBy(key, absorb, LABEL, *factors, *numerics).agg(
        F.count(F.lit(1)).alias("n"), F.avg("__y").alias("ym"), (F.var_pop("__y") * F.count(F.lit(1))).alias("m2")
    )


def absorbed_hc3(df: DataFrame, key: str, y: str, label: str, absorb: str) -> DataFrame:
    """Coefficient of a true/false label with one absorbed factor, in closed form.

    One aggregate gives both groups' size, mean and spread per level; all that
    follows reads one row per level. A level with one group only has no say.
    """
    lab, v = F.col(label).cast("boolean"), F.col(y).cast("double")
    aggs = []
    for tag, chosen in (("1", lab), ("0", ~lab)):
        x = F.when(chosen, v)
        aggs += [F.count(x).alias("n" + tag), F.coalesce(F.avg(x), F.lit(0.0)).alias("y" + tag)]
        aggs.append(F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias("s" + tag))
    factor = F.coalesce(F.col(absorb).cast("string"), F.lit("")).alias(absorb)
    levels = df.where(lab.isNotNull() & v.isNotNull()).groupBy(key, factor).agg(*aggs)
    nb = F.col("n1") + F.col("n0")
    levels = levels.withColumns({"nb": nb, "p": F.col("n1") / nb, "gap": F.col("y1") - F.col("y0")})
    # Within a level: d = 1 - p and -p, and the centred means are d * gap.
    spread = F.col("nb") * F.col("p") * (1 - F.col("p"))
    levels = materialize(levels.withColumn("w", spread), "levels")
    slope = levels.groupBy(key).agg(F.sum("w").alias("sdd"), F.sum(F.col("w") * F.col("gap")).alias("sdr"))
    slope = slope.withColumn("beta", F.try_divide(F.col("sdr"), F.nullif(F.col("sdd"), F.lit(0.0))))
    fit = lookup_join(levels, slope, [key], "inner", [absorb])

    def term(n: str, s: str, d: Column) -> Column:
        rest = F.lit(1.0) - (F.lit(1.0) / F.col("nb") + F.try_divide(d * d, F.nullif(F.col("sdd"), F.lit(0.0))))
        resid = d * (F.col("gap") - F.col("beta"))
        sse = F.col(s) + F.col(n) * resid * resid
        return F.when((F.abs(rest) < 1e-9) | (F.col(n) == 0), F.lit(0.0)).otherwise(d * d * sse / (rest * rest))

    both = F.when(F.col("w") > 0, term("n1", "s1", 1 - F.col("p")) + term("n0", "s0", -F.col("p"))).otherwise(F.lit(0.0))
    out = fit.groupBy(key).agg(
        F.sum("nb").alias("n"),
        F.max("beta").alias("label_coef"),
        (F.sqrt(F.sum(both)) / F.nullif(F.max("sdd"), F.lit(0.0))).alias("label_se"),
    )
    return _report(out.withColumn("status", F.when(F.col("label_coef").isNull(), "not_estimable").otherwise("ok")))


def _report(out: DataFrame) -> DataFrame:
    z = F.try_divide(F.col("label_coef"), F.nullif(F.col("label_se"), F.lit(0.0)))
    return out.withColumn("label_z", z).withColumns(
        {
            "label_p": p_normal(F.col("label_z")),
            "ci_low": F.col("label_coef") - F.lit(Z_95) * F.col("label_se"),
            "ci_high": F.col("label_coef") + F.lit(Z_95) * F.col("label_se"),
        }
    )


def _features(factors: list[str], numerics: list[str]) -> Column:
    """The cell's non-zero regressors as (name, value)."""
    entry = lambda name, value: F.struct(name.alias("f"), value.alias("x"))
    parts = [entry(F.lit(LABEL), F.col(LABEL))]
    parts += [entry(F.lit("num:" + x), F.col(x)) for x in numerics]
    parts += [entry(F.concat(F.lit(f + "="), F.col(f)), F.lit(1.0)) for f in factors]
    return F.array(*parts)


def _by_block(df: DataFrame, ids: list[str], value: str, block: int) -> DataFrame:
    """Sparse vectors cut into blocks: one row per id and block, at most ``block`` entries."""
    at = F.struct((F.col("i") % block).cast("int").alias("o"), F.col(value).alias("x"))
    cut = df.groupBy(*ids, F.expr(f"int(i div {block})").alias("b")).agg(F.collect_list(at).alias("e"))
    return cut.select(*ids, "b", F.col("e.o").alias("o"), F.col("e.x").alias("x"))


def _block_pairs(blocks: DataFrame, ids: list[str]) -> DataFrame:
    """Each vector's blocks beside each other: the tiles its outer product touches."""
    left = blocks.select(*ids, F.col("b").alias("bi"), F.col("o").alias("lo"), F.col("x").alias("lx"))
    right = blocks.select(*ids, F.col("b").alias("bj"), F.col("o").alias("ro"), F.col("x").alias("rx"))
    return left.join(right, ids)


def _outer(pairs: DataFrame, key: str, weight: Column) -> DataFrame:
    """Weighted outer products as (tile, offset in it, value)."""
    left, right = F.arrays_zip("lo", "lx"), F.arrays_zip("ro", "rx")
    cell = lambda a, b: F.struct(a["lo"].alias("p"), b["ro"].alias("q"), (a["lx"] * b["rx"] * weight).alias("v"))
    products = F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: cell(a, b))))
    return pairs.select(key, "bi", "bj", F.explode(products).alias("e")).select(key, "bi", "bj", "e.p", "e.q", "e.v")


def _fill(key: str, block: int):
    """Dense tile from its entries; a tile without any is zero."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        tile = np.zeros((block, block))
        kept = pdf[pdf.v.notna()]
        np.add.at(tile, (kept.p.to_numpy(dtype=int), kept.q.to_numpy(dtype=int)), kept.v.to_numpy())
        return pd.DataFrame({key: pdf[key].iloc[:1], "bi": pdf.bi.iloc[:1], "bj": pdf.bj.iloc[:1], "t": [tile.ravel()]})

    return fill


def _pivot_inverse(tile: np.ndarray) -> np.ndarray:
    """Inverse on the independent columns of a diagonal tile, zero on the others.

    The matrix has a unit diagonal, so what is left of a column's diagonal is the
    share of it that the columns before do not explain.
    """
    work, live = tile.copy(), np.zeros(len(tile), dtype=bool)
    for k in range(len(tile)):
        if work[k, k] < RANK_CUT:
            continue
        live[k] = True
        pivot, row, col = work[k, k], work[k].copy(), work[:, k].copy()
        work -= np.outer(col, row) / pivot
        work[k], work[:, k] = row / pivot, -col / pivot
        work[k, k] = 1.0 / pivot
    work[~live], work[:, ~live] = 0.0, 0.0
    return work


def _pivot_rows(block: int):
    def rows(batches):
        for pdf in batches:
            out = []
            for k, bj, t, d in zip(pdf["__k"], pdf.bj, pdf.t, pdf.d):
                inverse = _pivot_inverse(np.asarray(d).reshape(block, block))
                out.append((inverse if bj == k else inverse @ np.asarray(t).reshape(block, -1)).ravel())
            yield pdf.drop(columns=["__k", "t", "d"]).assign(g=out)

    return rows


def _swept(block: int):
    def sweep(batches):
        for pdf in batches:
            out = []
            for k, bi, bj, t, g, c in zip(pdf["__k"], pdf.bi, pdf.bj, pdf.t, pdf.g, pdf.c):
                if g is None or c is None:  # this key has fewer blocks
                    out.append(t)
                elif bi == k:
                    out.append(g)
                else:
                    product = np.asarray(c).reshape(block, block) @ np.asarray(g).reshape(block, -1)
                    out.append((-product if bj == k else np.asarray(t).reshape(block, -1) - product).ravel())
            yield pdf.drop(columns=["__k", "g", "c"]).assign(t=out)

    return sweep


def invert_tiles(tiles: DataFrame, key: str, n_blocks: int, block: int) -> DataFrame:
    """Generalised inverse of a tiled symmetric matrix by block Gauss-Jordan sweeps.

    ``tiles`` holds (key, bi, bj, t) with every tile present; tiles in column -1
    are right-hand sides and end as solutions. A round joins each tile with one
    tile of the pivot's row and one of its column, so no task holds more than a
    batch of tiles. Columns that depend on earlier ones get zero rows.
    """
    key_type = tiles.schema[key].dataType.simpleString()
    spark = tiles.sparkSession
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(n_blocks):
        step = F.lit(k).alias("__k")
        pivot = tiles.where((F.col("bi") == k) & (F.col("bj") == k)).select(key, F.col("t").alias("d"))
        row = tiles.where(F.col("bi") == k).select(key, "bj", step, "t").join(pivot, key)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")  # tiles, not rows
        try:
            row = materialize(row.mapInPandas(_pivot_rows(block), f"`{key}` {key_type}, bj int, g array<double>"), "row")
            column = tiles.where(F.col("bj") == k).select(key, "bi", F.col("t").alias("c"))
            joined = tiles.join(row, [key, "bj"], "left").join(column, [key, "bi"], "left")
            joined = joined.select(key, "bi", "bj", "t", step, "g", "c")
            tiles = materialize(
                joined.mapInPandas(_swept(block), f"`{key}` {key_type}, bi int, bj int, t array<double>"), "tiles"
            )
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    return tiles


def _products(block: int, columns: list[str], rows_at_once: int = 4096):
    """Rows of (left, right) vectors of one tile: w = T right on the left's places."""

    def multiply(pdf: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(tile):
            return pd.DataFrame({**{c: [] for c in columns}, "w": [], "q": []})
        t = np.asarray(tile.t.iloc[0]).reshape(block, block)
        ws, qs = [], []
        for start in range(0, len(pdf), rows_at_once):
            part = pdf.iloc[start : start + rows_at_once]
            right = np.zeros((len(part), block))
            at = np.repeat(np.arange(len(part)), part.ro.str.len())
            right[at, np.concatenate(part.ro.to_list())] = np.concatenate(part.rx.to_list())
            image = right @ t.T
            for r, (lo, lx) in enumerate(zip(part.lo, part.lx)):
                w = image[r, lo]
                ws.append(w)
                qs.append(float(w @ lx))
        return pdf[columns].assign(w=ws, q=qs)

    return multiply


def through_tiles(pairs: DataFrame, tiles: DataFrame, key: str, block: int, keep: list[str]) -> DataFrame:
    """Products of sparse vectors with a tiled matrix, tile by tile.

    A tile that many vectors touch is copied to as many groups as it takes for
    a group to hold about ``GROUP_ENTRIES`` entries.
    """
    place = [key, "bi", "bj"]
    size = F.size("lo") + F.size("ro")
    copies = pairs.groupBy(*place).agg(F.expr(f"int(sum(size(lo) + size(ro)) div {GROUP_ENTRIES})").alias("__copies"))
    copies = materialize(copies.withColumn("__copies", F.col("__copies") + 1), "copies")
    spread = lookup_join(pairs, copies, place, "inner", keep)
    spread = spread.withColumn("__salt", F.pmod(F.xxhash64(*keep), F.col("__copies")).cast("int")).where(size > 0)
    held = tiles.join(copies, place).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keep, "bi", "lo").schema)
    by = [*place, "__salt"]
    return spread.groupBy(*by).cogroup(held.select(*by, "t").groupBy(*by)).applyInPandas(
        _products(block, [*keep, "bi", "lo"]), f"{fields}, w array<double>, q double"
    )


def ols_hc3(
    df: DataFrame, key: str, y: str, label: str, absorb: str, factors: list[str], numerics: list[str],
    min_rows: int = 10, block: int = BLOCK,
) -> DataFrame:
    """Label coefficient per ``key`` given ``absorb``, ``factors`` and ``numerics``.

    The cross products of the regressors are a matrix in tiles of ``block`` x
    ``block`` values, inverted by block sweeps; leverages are sums of products
    with single tiles. No row and no task holds the matrix, so the factors
    beside the absorbed one may have thousands of levels.

    Regressors are scaled to unit length within the absorbed levels; one that
    does not vary there says nothing and is left out, and the label stands last,
    so that it is dropped, and reported as ``not_estimable``, exactly if the
    others explain it. Leverage-one cells (levels met once) are fitted exactly;
    they are counted and add nothing unless the label itself hangs on one, which
    is reported as ``leverage_one``.
    """
    cells = design_cells(df, key, y, label, absorb, factors, numerics)
    cells = materialize(cells.withColumn("cell", F.monotonically_increasing_id()), "cells")
    n, level = F.col("n"), [key, absorb]
    totals = cells.groupBy(*level).agg(F.sum("n").alias("nb"), (F.sum(n * F.col("ym")) / F.sum("n")).alias("yb"))
    totals = materialize(totals.withColumn("lev", F.monotonically_increasing_id()), "levels")
    cells = materialize(lookup_join(cells, totals, level, "inner", ["cell"]), "cells")

    entries = cells.select(key, "lev", "cell", "n", "ym", "nb", "yb", F.explode(_features(factors, numerics)).alias("e"))
    entries = entries.select(key, "lev", "cell", "n", "ym", "nb", "yb", "e.f", "e.x")
    sums = entries.groupBy(key, "lev", "f").agg(F.sum(n * F.col("x")).alias("s"), F.max("nb").alias("nb"))
    sums = materialize(sums.withColumn("m", F.col("s") / F.col("nb")), "sums")
    spread = entries.groupBy(key, "f").agg(
        F.sum(n * F.col("x") * F.col("x")).alias("raw"), F.sum(n * F.col("x") * (F.col("ym") - F.col("yb"))).alias("rhs")
    )
    spread = spread.join(sums.groupBy(key, "f").agg(F.sum(F.col("s") * F.col("m")).alias("cut")), [key, "f"])
    spread = spread.withColumn("scale", F.sqrt(F.greatest(F.col("raw") - F.col("cut"), F.lit(0.0))))
    live = spread.where(F.col("scale") * F.col("scale") > F.lit(VARIES) * F.col("raw"))
    order = Window.partitionBy(key).orderBy(F.col("f") == LABEL, "f")  # a row per regressor, not per observation
    features = live.select(
        key, "f", "scale", (F.col("rhs") / F.col("scale")).alias("rhs"), (F.row_number().over(order) - 1).alias("i")
    )
    features = materialize(features, "features")

    scaled = lambda d, v, ids: lookup_join(d, features.select(key, "f", "scale", "i"), [key, "f"], "inner", ids).withColumn(
        v, F.col(v) / F.col("scale")
    )
    entries = materialize(scaled(entries.select(key, "lev", "cell", "n", "f", "x"), "x", ["cell"]), "entries")
    means = materialize(scaled(sums.select(key, "lev", "nb", "f", "m"), "m", ["lev"]), "means")
    of_cells = _block_pairs(_by_block(entries, [key, "cell", "n"], "x", block), [key, "cell", "n"])
    of_levels = _block_pairs(_by_block(means, [key, "lev", "nb"], "m", block), [key, "lev", "nb"])
    of_cells, of_levels = materialize(of_cells, "cell_pairs"), materialize(of_levels, "level_pairs")

    # The matrix: products within cells less those of the level means.
    place = [key, "bi", "bj"]
    gram = _outer(of_cells, key, n).union(_outer(of_levels, key, -F.col("nb")))
    gram = gram.groupBy(*place, "p", "q").agg(F.sum("v").alias("v"))
    width = features.groupBy(key).agg((F.max("i") + 1).alias("p"))
    blocks = F.sequence(F.lit(0), F.expr(f"int((p - 1) div {block})"))
    every = width.select(key, F.explode(blocks).alias("bi"), blocks.alias("bs")).select(key, "bi", F.explode("bs").alias("bj"))
    key_type = df.schema[key].dataType.simpleString()
    tile_type = f"`{key}` {key_type}, bi int, bj int, t array<double>"
    tiles = every.join(gram, place, "left").groupBy(*place).applyInPandas(_fill(key, block), tile_type)
    in_block = F.expr(f"int(i div {block})").alias("bi")
    right = features.groupBy(key, in_block).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("i") % block).alias("o"), "rhs"))).alias("r")
    )
    right = right.select(
        key, "bi", F.lit(-1).alias("bj"),
        F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda o: F.coalesce(F.try_element_at("r", o), F.lit(0.0))).alias("t"),
    )
    n_blocks = width.agg(F.expr(f"coalesce(max((p - 1) div {block} + 1), 0)")).first()[0]
    tiles = invert_tiles(materialize(tiles.union(right), "tiles"), key, n_blocks, block)

    # Solutions and the label's column of the inverse, by regressor.
    own = features.where(F.col("f") == LABEL).select(key, F.col("i").alias("__l"), F.col("scale").alias("__ls"))
    column = tiles.join(own.withColumn("bj", F.expr(f"int(__l div {block})")), [key, "bj"])
    column = column.select(
        key, "bi", F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda o: F.get("t", o * block + F.col("__l") % block)).alias("il")
    )
    solved = tiles.where(F.col("bj") == -1).select(key, "bi", F.col("t").alias("beta")).join(column, [key, "bi"], "left")
    solved = solved.select(key, "bi", F.posexplode(F.arrays_zip("beta", "il")).alias("o", "e"))
    solved = solved.select(key, (F.col("bi") * block + F.col("o")).alias("i"), "e.beta", F.coalesce("e.il", F.lit(0.0)).alias("il"))
    vectors = materialize(features.select(key, "f", "i", "scale").join(solved, [key, "i"]), "vectors")
    label_row = vectors.where(F.col("f") == LABEL).select(
        key, (F.col("beta") / F.col("scale")).alias("coef"), F.col("scale").alias("__ls"), (F.col("il") > 0).alias("estimable")
    )

    inverse = tiles.where(F.col("bj") >= 0)
    x_part = through_tiles(of_cells, inverse, key, block, [key, "cell"]).groupBy("cell").agg(F.sum("q").alias("xx"))
    m_part = materialize(through_tiles(of_levels, inverse, key, block, [key, "lev"]), "image")
    v = m_part.select("lev", "bi", F.explode(F.arrays_zip("lo", "w")).alias("e"))
    v = v.groupBy("lev", (F.col("bi") * block + F.col("e.lo")).alias("i")).agg(F.sum("e.w").alias("v"))
    by_regressor = vectors.select(key, "i", "beta", "il")
    m_dot = lookup_join(means, by_regressor, [key, "i"], "inner", ["lev"]).groupBy("lev").agg(
        F.sum(F.col("m") * F.col("beta")).alias("mb"), F.sum(F.col("m") * F.col("il")).alias("ml")
    )
    levels = m_dot.join(m_part.groupBy("lev").agg(F.sum("q").alias("mm")), "lev")
    x_dot = lookup_join(entries, by_regressor, [key, "i"], "inner", ["cell"])
    x_dot = lookup_join(x_dot, materialize(v, "v"), ["lev", "i"], "inner", ["cell"]).groupBy("cell").agg(
        F.sum(F.col("x") * F.col("beta")).alias("xb"), F.sum(F.col("x") * F.col("il")).alias("xl"), F.sum(F.col("x") * F.col("v")).alias("xm")
    )
    full = cells.join(x_dot.join(x_part, "cell"), "cell", "left")
    full = lookup_join(full, materialize(levels, "level_sums"), ["lev"], "left", ["cell"])
    full = lookup_join(full, label_row, [key], "left", ["cell"])
    zero = F.lit(0.0)
    term = lambda name: F.coalesce(name, zero)  # noqa: E731 - a cell without a varying regressor has none
    full = full.select(
        key, "n", "ym", "m2", "coef", F.coalesce("estimable", F.lit(False)).alias("estimable"),
        (F.lit(1.0) - (F.lit(1.0) / F.col("nb") + term("xx") - 2 * term("xm") + term("mm"))).alias("rest"),
        ((F.col("ym") - F.col("yb")) - (term("xb") - term("mb"))).alias("resid"),
        F.try_divide(term("xl") - term("ml"), F.col("__ls")).alias("a"),
    )
    sse = F.col("m2") + n * F.col("resid") * F.col("resid")
    exact_fit = F.abs("rest") < 1e-9
    hc3 = F.when(exact_fit, zero).otherwise(F.col("a") * F.col("a") * sse / (F.col("rest") * F.col("rest")))
    hangs = exact_fit & (F.abs("a") > 1e-9)
    out = full.groupBy(key).agg(
        F.sum("n").alias("n"),
        F.max("coef").alias("label_coef"),
        F.sqrt(F.sum(hc3)).alias("label_se"),
        F.sum(F.when(exact_fit, n).otherwise(0)).alias("n_leverage_one"),
        F.max(hangs).alias("__hangs"),
        F.min("estimable").alias("__est"),
        F.sum(sse).alias("__sse"),
        F.sum(F.col("m2") + n * F.col("ym") * F.col("ym")).alias("__yy"),
        F.sum(n * F.col("ym")).alias("__sy"),
    )
    total = F.col("__yy") - F.col("__sy") * F.col("__sy") / F.col("n")
    status = (
        F.when(F.col("n") < min_rows, "too_few_rows")
        .when(~F.col("__est"), "not_estimable")
        .when(F.col("__hangs"), "leverage_one")
        .otherwise("ok")
    )
    out = out.withColumns({"r2": F.lit(1.0) - F.try_divide(F.col("__sse"), F.nullif(total, zero)), "status": status})
    for name in ("label_coef", "label_se"):
        out = out.withColumn(name, F.when(F.col("status") == "ok", F.col(name)))
    return _report(out.drop("__hangs", "__est", "__sse", "__yy", "__sy"))
