"""Matched filter, shrinkage selection and band-response operators.

Pixels ``(scene_id, line, xtrack, rad ARRAY<DOUBLE>, bad BOOLEAN)`` are never
grouped whole. Each task reduces its pixels to per-column moments, the moments
are merged per column, one small system is solved per column, and the weights
come back to the pixels as two arrays that built-in expressions apply.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..session import materialise

_KEYS = ["variant", "scene_id", "xtrack"]
_MOMENTS = "variant string, scene_id bigint, xtrack bigint, n bigint, mean array<double>, m2 array<double>"
_MODEL = (
    "variant string, scene_id bigint, xtrack bigint, n_good bigint, alpha double, mu array<double>, "
    "target array<double>, z array<double>, cond double, min_eig double, max_eig double, target_norm double, "
    "denom double, status string"
)


def in_windows(wl: Column, windows) -> Column:
    """Band centre inside any window, both ends included."""
    cond = F.lit(False)
    for lo, hi in windows:
        cond = cond | wl.between(lo, hi)
    return cond


def select_bands(bands: DataFrame, windows, exclude: tuple[float, float] | None = None) -> DataFrame:
    """Kept bands per scene as arrays ordered by band; fewer than two gives a status.

    ``exclude`` drops an open wavelength interval.
    """
    keep = in_windows(F.col("wl"), windows)
    if exclude is not None:
        keep = keep & ~((F.col("wl") > exclude[0]) & (F.col("wl") < exclude[1]))
    kept = F.array_sort(F.collect_list(F.when(keep, F.struct("band", "wl", "k"))))
    return (
        bands.groupBy("scene_id").agg(kept.alias("_kept"))
        .select(
            "scene_id",
            F.col("_kept.band").alias("kept_bands"),
            F.col("_kept.wl").alias("kept_wl"),
            F.col("_kept.k").alias("kept_k"),
            F.when(F.size("_kept") >= 2, "ok").otherwise("too few bands").alias("status"),
        )
    )


def bad_pixels(flags: Column, aggregate: bool = True) -> Column:
    """Exclusion from the flag array: the aggregate flag, or any of the first four."""
    if aggregate:
        return F.coalesce(F.get(flags, F.lit(4)), F.lit(0)) != 0
    return F.coalesce(F.exists(F.slice(flags, 1, 4), lambda x: x != 0), F.lit(False))


def target_signature(k: Column, mu: Column) -> Column:
    return F.zip_with(k, mu, lambda a, b: a * b)


def project_bands(pixels: DataFrame, selection: DataFrame) -> DataFrame:
    """Pixels reduced to the kept bands, one copy per variant in ``selection``.

    Pixels of a scene without enough bands stay, with NULL ``x`` and the reason in ``status``.
    """
    cols = [c for c in ("variant",) if c in selection.columns]
    sel = selection.select(*cols, "scene_id", "kept_bands", "kept_k", F.col("status").alias("_status"))
    joined = pixels.join(sel, "scene_id", "left").withColumn("status", F.coalesce("_status", F.lit("no bands"))).drop("_status")
    if "variant" not in selection.columns:
        joined = joined.withColumn("variant", F.lit("central"))
    k = F.col("kept_bands")
    first, n = F.get(k, F.lit(0)), F.size(k)
    rad = F.col("rad").cast("array<double>")
    # One unbroken window is a plain slice; several windows are gathered band by band.
    unbroken = F.get(k, n - 1) - first + 1 == n
    x = F.when(unbroken & (first + n <= F.size("rad")), F.slice(rad, (first + 1).cast("int"), n)).otherwise(
        F.transform(k, lambda i: F.get(rad, i.cast("int")))
    )
    return joined.withColumn("x", F.when(F.col("status") == "ok", x))


def good_pixels(projected: DataFrame) -> DataFrame:
    """The pixels that models are built from."""
    return projected.where(~F.col("bad") & F.col("x").isNotNull())


def _merge(a, b):
    """Combine two (n, mean, scatter) summaries."""
    if a is None:
        return b
    n = a[0] + b[0]
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


#: Bytes of pixels read before they are summed, and of summaries held before they are sent on.
_BUFFER_BYTES = 48 << 20
_HELD_BYTES = 96 << 20


def _column_groups(batches):
    """Rows of several Arrow batches sorted by column: yields ((variant, scene, xtrack), matrix)."""
    tab = pa.Table.from_batches(batches).combine_chunks()
    n = tab.num_rows
    lists = tab.column("x").combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    names = tab.column("variant").combine_chunks().dictionary_encode()
    var, scene, col = names.indices.to_numpy(), tab.column("scene_id").to_numpy(), tab.column("xtrack").to_numpy()
    order = np.lexsort((col, scene, var))
    var, scene, col, start, size = var[order], scene[order], col[order], start[order], size[order]
    cut = np.flatnonzero((np.diff(var) != 0) | (np.diff(scene) != 0) | (np.diff(col) != 0)) + 1
    words = names.dictionary.to_pylist()
    for lo, hi in zip(np.r_[0, cut], np.r_[cut, n], strict=True):
        # Variants may keep different numbers of bands; within a column all rows agree.
        x = flat[start[lo:hi, None] + np.arange(size[lo])]
        yield (words[var[lo]], int(scene[lo]), int(col[lo])), x


def _partial_moments(batches):
    """Per-task column summaries; bounded by the bytes buffered and held."""
    acc: dict[tuple, tuple] = {}
    held: list = []

    def absorb():
        for key, x in _column_groups(held):
            mu = x.mean(axis=0)
            d = x - mu
            acc[key] = _merge(acc.get(key), (len(x), mu, d.T @ d))
        held.clear()

    def flush():
        cols = list(zip(*[(*k, n, m, s.ravel()) for k, (n, m, s) in acc.items()], strict=True))
        acc.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()),
             pa.array(list(cols[4]), pa.list_(pa.float64())), pa.array(list(cols[5]), pa.list_(pa.float64()))],
            names=[*_KEYS, "n", "mean", "m2"],
        )

    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= _BUFFER_BYTES:
            absorb()
            size = 0
            if sum(m2.nbytes for _, _, m2 in acc.values()) > _HELD_BYTES:
                yield flush()
    if held:
        absorb()
    if acc:
        yield flush()


def column_moments(good: DataFrame) -> DataFrame:
    """Count, mean and scatter matrix per column, merged from per-task summaries."""
    partial = good.select(*_KEYS, "x").mapInArrow(_partial_moments, _MOMENTS)

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for n, mean, m2 in zip(pdf.n, pdf["mean"], pdf.m2, strict=True):
            mu = np.asarray(mean, dtype=float)
            total = _merge(total, (n, mu, np.asarray(m2, dtype=float).reshape(len(mu), len(mu))))
        n, mu, s = total
        return pd.DataFrame([(*[pdf[k].iloc[0] for k in _KEYS], n, mu.tolist(), s.ravel().tolist())],
                            columns=[*_KEYS, "n", "mean", "m2"])

    return partial.groupBy(*_KEYS).applyInPandas(combine, _MOMENTS)


def _solve(batches):
    """Solve each column's shrunk covariance system; one row per column."""
    for pdf in batches:
        rows = []
        for rec in pdf.itertuples(index=False):
            mu = np.asarray(rec.mean, dtype=float)
            b = len(mu)
            key = (rec.variant, rec.scene_id, rec.xtrack, rec.n)
            if rec.n < b + 2:
                rows.append((*key, None, mu.tolist(), None, None, None, None, None, None, None, "too few pixels"))
                continue
            cov = np.asarray(rec.m2, dtype=float).reshape(b, b) / (rec.n - 1)
            alpha = float(rec.alpha)
            shrunk = (1 - alpha) * cov + alpha * np.diag(np.diag(cov))
            s = np.asarray(rec.target if rec.target is not None else np.asarray(rec.kept_k) * mu, dtype=float)
            eig = np.linalg.eigvalsh(shrunk)
            extra = (float(eig[-1] / max(eig[0], 1e-300)), float(eig[0]), float(eig[-1]), float(np.linalg.norm(s)))
            try:
                z = np.linalg.solve(shrunk, s)
                denom = float(s @ z)
            except np.linalg.LinAlgError:
                rows.append((*key, alpha, mu.tolist(), s.tolist(), None, *extra, None, "singular"))
                continue
            if not np.isfinite(denom) or denom == 0.0:
                rows.append((*key, alpha, mu.tolist(), s.tolist(), None, *extra, None, "no target response"))
                continue
            rows.append((*key, alpha, mu.tolist(), s.tolist(), (z / denom).tolist(), *extra, denom, "ok"))
        yield pd.DataFrame(rows, columns=[f.split(" ")[0] for f in _MODEL.split(", ")])


def column_models(
    moments: DataFrame, selection: DataFrame, alpha: DataFrame | float = C.SHRINKAGE,
    target: DataFrame | None = None,
) -> DataFrame:
    """Filter weights per column. ``alpha`` is a number or a table by column.

    ``target`` overrides the signature per column (used to prove that a wrong
    signature fails).
    """
    sel = selection.select("scene_id", "kept_k", *[c for c in ("variant",) if c in selection.columns])
    base = moments.join(sel, ["scene_id", "variant"] if "variant" in selection.columns else ["scene_id"])
    if isinstance(alpha, DataFrame):
        base = base.join(alpha.select(*_KEYS, "alpha"), _KEYS, "left").withColumn(
            "alpha", F.coalesce("alpha", F.lit(0.0))
        )
    else:
        base = base.withColumn("alpha", F.lit(float(alpha)))
    if target is not None:
        base = base.join(target.select("scene_id", "xtrack", "target"), ["scene_id", "xtrack"], "left")
    else:
        base = base.withColumn("target", F.lit(None).cast("array<double>"))
    return base.select(*_KEYS, "n", "mean", "m2", "kept_k", "alpha", "target").mapInPandas(_solve, _MODEL)


def apply_filter(projected: DataFrame, models: DataFrame, scale: float = C.PPM_SCALE) -> DataFrame:
    """Enhancement per pixel with a status; excluded pixels and skipped columns and scenes are NULL."""
    w = models.select(*_KEYS, "mu", "z", F.col("status").alias("_model"))
    score = F.aggregate(
        F.zip_with(F.zip_with("x", "mu", lambda a, b: a - b), "z", lambda a, b: a * b),
        F.lit(0.0), lambda acc, v: acc + v,
    )
    return projected.join(w, _KEYS, "left").select(
        *_KEYS, "line",
        F.when(~F.col("bad") & F.col("z").isNotNull(), score * scale).alias("enh"),
        F.when(F.col("status") != "ok", F.col("status")).when(F.col("bad"), "bad pixel")
        .otherwise(F.coalesce("_model", F.lit("no good pixels"))).alias("status"),
    )


#: Bytes of eigen-systems that one join may broadcast; a larger archive is worked through in rounds of whole scenes.
EIGEN_BYTES = 192 << 20
_STEPS = int(round((C.LOO_LOG10_MAX - C.LOO_LOG10_MIN) / C.LOO_LOG10_STEP)) + 1
_GRID = 10.0 ** (C.LOO_LOG10_MIN + C.LOO_LOG10_STEP * np.arange(_STEPS))
_EIGEN = (
    "variant string, scene_id bigint, xtrack bigint, n bigint, b int, mean array<double>, root array<double>, "
    "lam array<double>, vec array<double>, logdet array<double>"
)
_BLOCKS = "variant string, scene_id bigint, xtrack bigint, m bigint, x array<double>"
_TERMS = "variant string, scene_id bigint, xtrack bigint, term array<double>"


def eigen_systems(moments: DataFrame) -> DataFrame:
    """Whitened eigen-system of every column's scatter and the log-determinant for every candidate, as a table.

    A column with fewer than two pixels or a band without spread has no system and no row.
    """

    def solve(frames):
        for pdf in frames:
            rows = []
            for rec in pdf.itertuples(index=False):
                mu = np.asarray(rec.mean, dtype=float)
                b, n = len(mu), int(rec.n)
                if n < 2 or not b:
                    continue
                cov = np.asarray(rec.m2, dtype=float).reshape(b, b) / (n - 1) * C.LOO_DATA_SCALE**2
                var = np.diag(cov)
                if np.any(~(var > 0)):
                    continue
                root = np.sqrt(var)
                lam, vec = np.linalg.eigh(cov / np.outer(root, root))
                spread = n * np.outer(lam, (1.0 - _GRID) / (n - 1.0)) + _GRID
                with np.errstate(divide="ignore", invalid="ignore"):
                    det = np.where(np.any(spread <= 0, axis=0), np.nan, np.log(spread).sum(axis=0)) + np.log(var).sum()
                rows.append((rec.variant, rec.scene_id, rec.xtrack, n, b, mu.tolist(), root.tolist(), lam.tolist(), vec.ravel().tolist(), det.tolist()))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _EIGEN.split(", ")])

    return materialise(moments.select(*_KEYS, "n", "mean", "m2").mapInPandas(solve, _EIGEN), "eigen")


def _column_blocks(batches):
    """A task's pixels as one matrix per column and buffer, so that a join meets blocks and not pixels."""

    def blocks(held):
        keys, xs = [], []
        for key, x in _column_groups(held):
            keys.append((*key, len(x)))
            xs.append(x.ravel())
        cols = list(zip(*keys, strict=True))
        offsets = np.cumsum([0, *map(len, xs)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]],
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(xs).astype(float)))],
            names=[*_KEYS, "m", "x"],
        )

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= _BUFFER_BYTES:
            yield blocks(held)
            held, size = [], 0
    if held:
        yield blocks(held)


def _block_terms(centred: bool):
    """Sums of the leave-one-out term for every candidate, added up per column within a task."""

    def run(batches):
        acc: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r] for name in ("n", "b", "m", "mean", "root", "lam", "vec", "x")}
                n, b, m = (row[k].as_py() for k in ("n", "b", "m"))
                mean, root, lam, vec, x = (row[k].values.to_numpy() for k in ("mean", "root", "lam", "vec", "x"))
                x = x.reshape(m, b)
                y2 = (((x - mean if centred else x) * C.LOO_DATA_SCALE / root) @ vec.reshape(b, b)) ** 2
                beta = (1.0 - _GRID) / (n - 1.0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    near = y2 @ (1.0 / (n * np.outer(lam, beta) + _GRID))
                    q = 1.0 - beta * near
                    term = np.where(np.any(q <= 0, axis=0), np.nan, (np.log(q) + near / q).sum(axis=0))
                key = tuple(batch.column(k)[r].as_py() for k in _KEYS)
                acc[key] = acc[key] + term if key in acc else term
            if len(acc) * _STEPS * 8 > _HELD_BYTES:
                yield _term_rows(acc)
        if acc:
            yield _term_rows(acc)

    return run


def _term_rows(acc: dict[tuple, np.ndarray]) -> pa.RecordBatch:
    cols = list(zip(*acc, strict=True))
    sums = pa.array([v.tolist() for v in acc.values()], pa.list_(pa.float64()))
    acc.clear()
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), sums],
                                      names=[*_KEYS, "term"])


def _rounds(systems: DataFrame, limit: int) -> list[tuple[int, int] | None]:
    """Ranges of scene ids whose eigen-systems stay below ``limit`` bytes; None where one range holds all.

    The driver sees a count per range of scenes, at most 4,096 of them: ranges of equal
    width, halved until each is light or a single scene.
    """
    size = F.sum(F.col("b").cast("bigint") * F.col("b") * 8 + 8 * _STEPS)
    low, high, total = systems.agg(F.min("scene_id"), F.max("scene_id"), size).first()
    if total is None or total <= limit:
        return [None]
    width = max(1, -(-(high - low + 1) // 4096))
    per = {r["k"]: r["s"] for r in systems.groupBy(F.floor((F.col("scene_id") - low) / width).alias("k")).agg(size.alias("s")).collect()}
    out: list[tuple[int, int] | None] = []
    begin, held = None, 0
    for k in sorted(per):
        if begin is not None and held + per[k] > limit:
            out.append((low + begin * width, low + k * width))
            begin, held = None, 0
        begin, held = (k if begin is None else begin), held + per[k]
    out.append((low + begin * width, high + 1))
    return out


def loo_curve(good: DataFrame, systems: DataFrame, centred: bool = False, limit: int = EIGEN_BYTES) -> DataFrame:
    """Leave-one-out likelihood per column and candidate: ``variant, scene_id, xtrack, alpha, nll`` (NULL where undefined).

    Pixels stay where they are read: each task turns its own into blocks per column, meets
    the eigen-systems of :func:`eigen_systems` by a broadcast of at most ``limit`` bytes, and
    sends on 201 sums per column. Where all systems together are larger, ranges of scenes
    follow one another, each reading only its scenes' pixels; a single scene is broadcast
    whole (its columns times the square of its bands).
    """
    sums = None
    for bounds in _rounds(systems, limit):
        part, mine = good, systems
        if bounds is not None:
            within = (F.col("scene_id") >= bounds[0]) & (F.col("scene_id") < bounds[1])
            part, mine = good.where(within), systems.where(within)
        blocks = part.select(*_KEYS, "x").mapInArrow(_column_blocks, _BLOCKS)
        met = blocks.join(F.broadcast(mine.drop("logdet")), _KEYS)
        terms = met.mapInArrow(_block_terms(centred), _TERMS).select(*_KEYS, F.posexplode("term").alias("i", "term"))
        terms = terms.groupBy(*_KEYS, "i").agg(F.sum("term").alias("term"))
        if bounds is not None:
            terms = materialise(terms, "loo-terms")
        sums = terms if sums is None else sums.unionByName(terms)
    of = systems.select(*_KEYS, "n", "b", F.posexplode("logdet").alias("i", "logdet"))
    nll = 0.5 * (F.col("b") * float(np.log(2 * np.pi)) + F.col("logdet")) + F.col("term") / (2 * F.col("n"))
    alpha = F.get(F.array(*[F.lit(float(a)) for a in _GRID]), F.col("i"))
    return sums.join(of, [*_KEYS, "i"]).select(*_KEYS, alpha.alias("alpha"), F.when(~F.isnan(nll), nll).alias("nll"))


def loo_alpha(good: DataFrame, moments: DataFrame, centred: bool = False, systems: DataFrame | None = None, limit: int = EIGEN_BYTES) -> DataFrame:
    """Leave-one-out shrinkage per column: the candidate of least likelihood loss, the smallest of equal ones.

    Columns with no valid candidate, or without an eigen-system, get 0. ``systems`` may be
    passed where several calls share them.
    """
    systems = eigen_systems(moments) if systems is None else systems
    curve = loo_curve(good, systems, centred, limit).where(F.col("nll").isNotNull())
    best = curve.groupBy(*_KEYS).agg(F.min(F.struct("nll", "alpha")).alias("_best"))
    return moments.select(*_KEYS).join(best, _KEYS, "left").select(*_KEYS, F.coalesce("_best.alpha", F.lit(0.0)).alias("alpha"))


def matched_filter(
    pixels: DataFrame, bands: DataFrame, windows=C.CH4_WINDOWS_NM, alpha: float | str = C.SHRINKAGE,
    scale: float = C.PPM_SCALE, target: DataFrame | None = None,
) -> DataFrame:
    """Per-column matched filter over all scenes. ``alpha="loocv"`` selects it per column."""
    selection = select_bands(bands, windows)
    projected = project_bands(pixels, selection)
    good = good_pixels(projected)
    moments = column_moments(good)
    if alpha == "loocv":
        # Selection and solution both read the moments.
        moments = materialise(moments, "moments")
        alpha = loo_alpha(good, moments)
    # Written once: its true size decides whether the weights are broadcast or joined by shuffle.
    models = materialise(column_models(moments, selection, alpha, target).select(*_KEYS, "mu", "z", "status"), "column-weights")
    return apply_filter(projected, models, scale)


def band_response(hires: DataFrame, bands: DataFrame, block_nm: float = 5.0) -> DataFrame:
    """Gaussian band response by the trapezoid rule over points within four sigma.

    The range condition is turned into an equality on wavelength blocks.
    Bands outside the fine grid's coverage get 0.
    """
    near = _points_in_band(hires, bands, block_nm)
    w = W.partitionBy("scene_id", "band").orderBy("nm")
    step = F.lead("nm").over(w) - F.col("nm")
    f = F.col("w") * F.col("kx")
    seg = near.select(
        "scene_id", "band",
        ((f + F.lead(f).over(w)) / 2 * step).alias("_num"),
        ((F.col("w") + F.lead("w").over(w)) / 2 * step).alias("_den"),
    )
    ratio = seg.groupBy("scene_id", "band").agg(F.sum("_num").alias("_num"), F.sum("_den").alias("_den"))
    return bands.join(ratio, ["scene_id", "band"], "left").select(
        "scene_id", "band", "wl",
        F.coalesce(F.when(F.col("_den") != 0, F.col("_num") / F.col("_den")), F.lit(0.0)).alias("k"),
    )


def _points_in_band(hires: DataFrame, bands: DataFrame, block_nm: float) -> DataFrame:
    """Fine-grid points within four sigma of each covered band, with Gaussian weight ``w``."""
    sigma = F.col("fwhm") / C.FWHM_PER_SIGMA
    cover = hires.groupBy("scene_id").agg(F.min("nm").alias("_lo"), F.max("nm").alias("_hi"))
    b = (
        bands.join(cover, "scene_id").where(F.col("wl").between(F.col("_lo"), F.col("_hi")))
        .select(
            "scene_id", "band", "wl", sigma.alias("sigma"),
            F.explode(
                F.sequence(
                    F.floor((F.col("wl") - 4 * sigma) / block_nm).cast("bigint"),
                    F.floor((F.col("wl") + 4 * sigma) / block_nm).cast("bigint"),
                )
            ).alias("_blk"),
        )
    )
    h = hires.withColumn("_blk", F.floor(F.col("nm") / block_nm).cast("bigint"))
    z = (F.col("nm") - F.col("wl")) / F.col("sigma")
    return (
        h.join(b, ["scene_id", "_blk"])
        .where(F.col("nm").between(F.col("wl") - 4 * F.col("sigma"), F.col("wl") + 4 * F.col("sigma")))
        .withColumn("w", F.exp(-0.5 * z * z))
        .drop("_blk")
    )


def saturating_response(
    hires: DataFrame, bands: DataFrame, state: DataFrame, c_max: float = 10000.0, n_c: int = 21,
    block_nm: float = 5.0,
) -> DataFrame:
    """Slope of log band radiance over a ladder of enhancements, per band.

    ``state`` holds per scene ``amf``, ``n_excess`` and ``n_background``.
    ``hires.kx`` is the cross-section.
    """
    pts = _points_in_band(hires, bands, block_nm).join(state, "scene_id")
    ladder = pts.withColumn(
        "_i", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1)))
    ).withColumn("c", F.col("_i") * (c_max / (n_c - 1)))
    od = F.col("amf") * (F.col("kx") * F.col("n_background") + F.col("kx") * F.col("n_excess") * F.col("c"))
    radiance = ladder.groupBy("scene_id", "band", "c").agg(
        (F.sum(F.col("w") * F.exp(-od)) / F.sum("w")).alias("rad")
    )
    slope = radiance.groupBy("scene_id", "band").agg(F.regr_slope(F.log("rad"), F.col("c")).alias("k"))
    return bands.join(slope, ["scene_id", "band"], "left").select(
        "scene_id", "band", "wl", F.coalesce("k", F.lit(0.0)).alias("k")
    )


def thin_absorption(sigma: Column, amf: Column, n_excess: Column) -> Column:
    """Optically thin absorption per unit enhancement."""
    return -amf * sigma * n_excess
