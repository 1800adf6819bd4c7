"""Queries of the operators on the driver's tables, and the same in SQL.

Files are documents (named by their number, classed by language); images are vectors, as 8 by 8 pixels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.functions import kernels, names
from pixelframe.operators import balance, distribution, drawplan, features, pixels
from pixelframe.plans import jobs
from pixelframe.sources import sinks
from pixelframe.sources.images import documents_as_files, embeddings_as_images, test_image, told

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Functions that read no table, with their SQL: tests alone compare them.
FIXED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _query(sql: str | None = None, fixed: bool = False):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        name = f.__name__.removeprefix("q_")
        if fixed:
            FIXED[name] = f, sql
            return f
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


# Files: statistics, balancing, names.

_ENDINGS = "['.jpg', '.JPG', '.jpeg', '.png', '.PNG', '.bmp', '.gif', '.tiff', '.tif', '.txt']"
_FILES = f"files AS (SELECT lang AS class, 'image (' || doc_id || ')' || {_ENDINGS}[doc_id % 10 + 1] AS name, lower({_ENDINGS}[doc_id % 10 + 1]) AS ext, text AS content FROM documents)"
_in = lambda exts: "(" + ", ".join(f"'{e}'" for e in exts) + ")"
_DEDUP = f"""{_FILES}, dedup AS (SELECT class, name, row_number() OVER (PARTITION BY class, sha256(content) ORDER BY name) = 1 AS is_kept FROM files WHERE ext IN {_in(names.AUGMENTATION)})"""
_NEED = f"""{_DEDUP}, counts AS (SELECT class, count(*) AS raw, count(*) FILTER (is_kept) AS kept FROM dedup GROUP BY 1),
need AS (SELECT class, raw, kept, (SELECT max(raw) FROM counts) AS target, greatest((SELECT max(raw) FROM counts) - kept, 0) AS need FROM counts)"""
_ROBIN = f"""{_NEED}, kept AS (SELECT class, name, row_number() OVER (PARTITION BY class ORDER BY name) - 1 AS i FROM dedup WHERE is_kept),
robin AS (SELECT class, name, i, need // kept + CASE WHEN i < need % kept THEN 1 ELSE 0 END AS copies, i * (need // kept) + least(i, need % kept) AS first FROM kept JOIN need USING (class)),
fan AS (SELECT class, name, k, first + k AS ordinal FROM (SELECT *, unnest(range(copies)) AS k FROM robin))"""


@_query(f"WITH {_FILES}, c AS (SELECT class, count(*) AS n FROM files WHERE ext IN {_in(names.DISTRIBUTION)} GROUP BY 1) SELECT class, n, n / sum(n) OVER () * 100 AS pct FROM c")
def q_class_distribution(spark: SparkSession, d: str) -> DataFrame:
    return distribution.distribution(documents_as_files(spark, d), "documents")


@_query(f"WITH {_FILES} SELECT class, count(*) AS n FROM files WHERE ext IN {_in(names.DISTRIBUTION)} GROUP BY GROUPING SETS ((class), ())")
def q_class_distribution_total(spark: SparkSession, d: str) -> DataFrame:
    return distribution.with_total(documents_as_files(spark, d))


_MODULES = {"distribution": names.DISTRIBUTION, "augmentation": names.AUGMENTATION, "transformation": names.TRANSFORMATION}


@_query(f"WITH {_FILES} " + " UNION ALL ".join(f"SELECT '{m}' AS module, class, count(*) AS n FROM files WHERE ext IN {_in(e)} GROUP BY class" for m, e in _MODULES.items()))
def q_extension_filter_by_module(spark: SparkSession, d: str) -> DataFrame:
    files = documents_as_files(spark, d)
    of = F.array(*(F.when(names.is_image(F.col("name"), e), F.lit(m)) for m, e in _MODULES.items()))
    return files.select("class", F.explode(F.array_compact(of)).alias("module")).groupBy("module", "class").agg(F.count("*").alias("n"))


@_query(f"WITH {_FILES} SELECT 'documents' AS class, count(*) AS n, 100.0::DOUBLE AS pct FROM files WHERE ext IN {_in(names.DISTRIBUTION)}")
def q_direct_image_shortcut(spark: SparkSession, d: str) -> DataFrame:
    files = documents_as_files(spark, d)
    return distribution.distribution(files, "documents", files)


@_query(f"WITH {_FILES} SELECT c.class, count(f.class) AS n FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('it'), ('pt')) AS c(class) LEFT JOIN (SELECT class FROM files WHERE ext IN {_in(names.DISTRIBUTION)}) f USING (class) GROUP BY 1")
def q_zero_count_classes(spark: SparkSession, d: str) -> DataFrame:
    classes = spark.createDataFrame([(c,) for c in ("de", "en", "es", "fr", "it", "pt")], "class string")
    return distribution.class_counts(documents_as_files(spark, d), classes=classes)


def _deduped(spark: SparkSession, d: str) -> DataFrame:
    return balance.dedup(documents_as_files(spark, d))


@_query(f"WITH {_DEDUP} SELECT class, name FROM dedup WHERE is_kept")
def q_dedup_kept(spark: SparkSession, d: str) -> DataFrame:
    return _deduped(spark, d).where("is_kept").select("class", "name")


@_query(f"WITH {_DEDUP} SELECT class, name FROM dedup WHERE NOT is_kept")
def q_dedup_dropped(spark: SparkSession, d: str) -> DataFrame:
    return _deduped(spark, d).where("NOT is_kept").select("class", "name")


@_query(f"WITH {_NEED} SELECT max(target) AS target FROM need")
def q_auto_target(spark: SparkSession, d: str) -> DataFrame:
    return balance.need(_deduped(spark, d)).agg(F.max("target").alias("target"))


@_query(f"WITH {_NEED} SELECT class, raw, kept, raw - kept AS dropped, target, need FROM need")
def q_balance_summary(spark: SparkSession, d: str) -> DataFrame:
    return balance.need(_deduped(spark, d)).select("class", "raw", "kept", (F.col("raw") - F.col("kept")).alias("dropped"), "target", "need")


@_query(f"WITH {_NEED} SELECT sum(need)::BIGINT AS produced, sum(raw - kept)::BIGINT AS dropped, count(*) AS classes FROM need")
def q_run_totals(spark: SparkSession, d: str) -> DataFrame:
    return balance.need(_deduped(spark, d)).agg(F.sum("need").alias("produced"), F.sum(F.col("raw") - F.col("kept")).alias("dropped"), F.count("*").alias("classes"))


def _robin(spark: SparkSession, d: str, target: int | None = None) -> DataFrame:
    deduped = _deduped(spark, d)
    return balance.round_robin(deduped, balance.need(deduped, target))


@_query(f"WITH {_ROBIN} SELECT class, name, i, copies FROM robin")
def q_round_robin_copies(spark: SparkSession, d: str) -> DataFrame:
    return _robin(spark, d).select("class", "name", "i", "copies")


_FILL = _ROBIN.replace("(SELECT max(raw) FROM counts)", "700")


@_query(f"WITH {_FILL} SELECT class, name, k, ordinal FROM fan WHERE class = 'es'")
def q_fill_to_target(spark: SparkSession, d: str) -> DataFrame:
    deduped = balance.dedup(documents_as_files(spark, d).where("class = 'es'"))
    return balance.fan_out(balance.round_robin(deduped, balance.need(deduped, 700)))


@_query(f"WITH {_FILES} SELECT class, name, k, k AS ordinal FROM (SELECT class, name, unnest(range(6)) AS k FROM files WHERE name = 'image (10).jpg')")
def q_single_variants(spark: SparkSession, d: str) -> DataFrame:
    return balance.variants(documents_as_files(spark, d).where("name = 'image (10).jpg'"), 6)


@_query(f"WITH {_ROBIN} SELECT class, name, k, ordinal FROM fan")
def q_fan_out_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return balance.fan_out(_robin(spark, d))


@_query(f"WITH {_ROBIN} SELECT class, name, k, 'augmented' AS kind FROM fan UNION ALL SELECT class, name, NULL AS k, 'raw' AS kind FROM dedup WHERE is_kept")
def q_copy_raw_union(spark: SparkSession, d: str) -> DataFrame:
    deduped = _deduped(spark, d)
    made = balance.fan_out(balance.round_robin(deduped, balance.need(deduped))).select("class", "name", "k", F.lit("augmented").alias("kind"))
    return made.unionByName(deduped.where("is_kept").select("class", "name", F.lit(None).cast("long").alias("k"), F.lit("raw").alias("kind")))


_STEM = "left(name, length(name) - length(regexp_extract(name, '[^/]([.][^./]+)$', 1)))"
_SUFFIX = "regexp_extract(name, '[^/]([.][^./]+)$', 1)"


@_query(f"WITH {_ROBIN} SELECT class, {_STEM} || '_Rotate_Shear_' || k || {_SUFFIX} AS output FROM fan")
def q_output_names_aug(spark: SparkSession, d: str) -> DataFrame:
    methods = F.array(*(F.lit(m.name) for m in drawplan.lookup("rotate, SHEAR")))
    return balance.fan_out(_robin(spark, d)).select("class", names.augmented(F.col("name"), methods, F.col("k")).alias("output"))


@_query(f"WITH {_FILES} SELECT class, {_STEM} || '_Flip' || {_SUFFIX} AS output FROM files")
def q_output_names_single(spark: SparkSession, d: str) -> DataFrame:
    return documents_as_files(spark, d).select("class", names.transformed(F.col("name"), F.lit("Flip")).alias("output"))


@_query(f"WITH {_FILES} SELECT t || '/' || class || '/' || {_STEM} || '_' || t || {_SUFFIX} AS output FROM files, (VALUES ('blur'), ('mask'), ('roi')) AS x(t) WHERE ext IN {_in(names.TRANSFORMATION)}")
def q_output_names_transform(spark: SparkSession, d: str) -> DataFrame:
    files = documents_as_files(spark, d).where(names.is_image(F.col("name"), names.TRANSFORMATION)).withColumn("t", F.explode(F.array(F.lit("blur"), F.lit("mask"), F.lit("roi"))))
    return files.select(F.concat("t", F.lit("/"), "class", F.lit("/"), names.transformed(F.col("name"), F.col("t"))).alias("output"))


_POOL_SQL = ", ".join(f"({k}, '{m.name}')" for k, m in enumerate(drawplan.POOL))


@_query(f"""WITH pool(method_id, name) AS (VALUES {_POOL_SQL}), asked AS (SELECT unnest(string_split(' rotate,FLIP , Blur,crop', ',')) AS said, unnest(range(4)) AS nth)
SELECT nth::INTEGER AS nth, trim(said) AS said, name, name IS NOT NULL AS known FROM asked LEFT JOIN pool ON lower(trim(said)) = lower(name)""", fixed=True)
def q_method_lookup(spark: SparkSession, d: str) -> DataFrame:
    pool = spark.createDataFrame([(m.name,) for m in drawplan.POOL], "name string")
    asked = spark.range(1).select(F.posexplode(F.split(F.lit(" rotate,FLIP , Blur,crop"), ",")).alias("nth", "said")).withColumn("said", F.trim("said"))
    return asked.join(F.broadcast(pool), F.lower("said") == F.lower("name"), "left").select("nth", "said", "name", F.col("name").isNotNull().alias("known"))


#: What the random stream of a seed gives, as ordinal, seed of crops, methods and sum of magnitudes.
_DRAWS_42 = """
(0, 942484272, 'Flip_Crop', 0.9575793759734148), (1, 202244314, 'Crop_Flip', 0.9926867054910268), (2, 1688060240, 'Skew_Crop', 0.5583391496124422),
(3, 1382689815, 'Flip_Distortion', 0.129104645308332), (4, 487991438, 'Distortion_Shear', -0.021586713954963088), (5, 1627981024, 'Skew_Rotate',
19.851190461624746), (6, 417983441, 'Skew_Crop', 0.4526017093288221), (7, 1599364550, 'Skew_Crop', 0.9871389661538779), (8, 406886644, 'Flip_Shear',
-0.15774942737543785), (9, 1438414599, 'Rotate_Distortion', -3.0093327779603274), (10, 670802254, 'Crop_Skew', 1.0650235823347463), (11, 1465647933,
'Rotate_Crop', -17.25240335879198), (12, 1689907231, 'Crop_Flip', 0.8994552569776096), (13, 1676602826, 'Crop_Shear', 0.7210900102937223), (14,
1435384429, 'Flip_Rotate', -1.4451896928433747), (15, 1642822536, 'Skew_Crop', 0.980740780618776), (16, 66180795, 'Skew_Rotate', -4.782786576537058),
(17, 502381220, 'Distortion_Crop', 0.6077362642822253), (18, 1421454890, 'Rotate_Crop', 3.78677707979584), (19, 872709139, 'Skew_Crop',
0.6954096046844012), (20, 1551254892, 'Flip_Distortion', -0.015249107899445058), (21, 1075985460, 'Skew_Flip', -0.09082051332545732), (22, 818236852,
'Distortion_Shear', -0.08255708287193783), (23, 253415744, 'Flip_Crop', 0.9885692993648544), (24, 1502609627, 'Distortion_Rotate', 23.36516685197),
(25, 1539509957, 'Crop_Rotate', -10.553113457098913), (26, 1938323886, 'Distortion_Flip', -0.017689484066555572), (27, 657036846, 'Skew_Rotate',
17.68430961574745), (28, 1545034932, 'Crop_Flip', 0.829627911932531), (29, 1254340836, 'Skew_Rotate', -4.369055337852693), (30, 1060837206,
'Flip_Skew', -0.31536875928070063), (31, 1261957108, 'Flip_Skew', 0.057427852148209946), (32, 744897232, 'Skew_Crop', 0.7557993814791022), (33,
1680911100, 'Distortion_Shear', -0.17596186995395208), (34, 1227776642, 'Distortion_Shear', -0.17118637540344017), (35, 942555183, 'Shear_Skew',
-0.03899248186709825), (36, 233164628, 'Skew_Rotate', 7.943216060722382), (37, 1650657918, 'Skew_Crop', 0.783315871924567), (38, 1191536604,
'Flip_Rotate', -6.453885806878063), (39, 1735706818, 'Crop_Rotate', 23.44011142133406), (40, 1106076761, 'Skew_Rotate', -16.654403924529152), (41,
934363821, 'Flip_Shear', 0.3536211321243004), (42, 1912962306, 'Flip_Crop', 0.968033991909359), (43, 678452472, 'Skew_Flip', 0.26020421716724945),
(44, 202865624, 'Shear_Distortion', 0.17842531112226798), (45, 263620652, 'Rotate_Crop', 17.301618901232658), (46, 1287164742, 'Rotate_Skew',
18.432157045042022), (47, 2086981357, 'Distortion_Crop', 0.7434657252463122), (48, 493182568, 'Flip_Crop', 0.7395466653359563), (49, 261633310,
'Flip_Crop', 0.8518989794861899), (50, 1247938414, 'Crop_Distortion', 0.8815825059709224), (51, 1586956063, 'Crop_Flip', 0.739317325467194), (52,
1991925409, 'Shear_Flip', -0.12058924575764786), (53, 1423490056, 'Flip_Shear', 0.09682779357160998), (54, 53385350, 'Distortion_Crop',
0.9122717504350554), (55, 301376989, 'Crop_Flip', 0.8257342957948911), (56, 1279991635, 'Distortion_Flip', 0.1732092886400845), (57, 1003694346,
'Crop_Skew', 0.41161750322128987), (58, 1711151666, 'Crop_Rotate', 2.3082717525426046), (59, 1863455212, 'Skew_Distortion', -0.040919146669683354),
(60, 1400011216, 'Shear_Crop', 0.9029068744168574), (61, 1602053466, 'Rotate_Distortion', 15.670549403137173), (62, 1276536571, 'Flip_Crop',
0.7438519732578095), (63, 666438637, 'Crop_Flip', 0.7431615798913428)
"""
_DRAWS_7 = """
(0, 1926751965, 'Crop_Skew', 0.6479297920146485), (1, 11307154, 'Rotate_Distortion', 16.180248690639132), (2, 650757180, 'Flip_Shear',
-0.18668192009804085), (3, 1083509134, 'Shear_Crop', 1.1573976299676798), (4, 2123775744, 'Distortion_Skew', -0.2502255378272352), (5, 76622814,
'Distortion_Flip', 0.005955528108548103)
"""
_draws_sql = lambda rows: f"draws(ordinal, crop_seed, methods, total) AS (VALUES {rows})"


@_query(f"WITH {_draws_sql(_DRAWS_42)} SELECT ordinal::BIGINT AS ordinal, crop_seed::BIGINT AS crop_seed, methods, total::DOUBLE AS total FROM draws", fixed=True)
def q_draw_plan(spark: SparkSession, d: str) -> DataFrame:
    total = F.aggregate("steps", F.lit(0.0), lambda n, s: n + F.aggregate(F.map_values(s["values"]), F.lit(0.0), lambda m, v: m + v))
    return drawplan.draw_plan(spark, 64, 42).select("ordinal", "crop_seed", F.array_join("methods", "_").alias("methods"), total.alias("total"))


@_query(f"WITH {_FILES}, {_draws_sql(_DRAWS_7)} SELECT class, name, {_STEM} || '_' || methods || '_' || ordinal || {_SUFFIX} AS output FROM files, draws")
def q_planned_outputs(spark: SparkSession, d: str) -> DataFrame:
    return jobs.plan_outputs(documents_as_files(spark, d), seed=7, n=6).select("class", "name", "output")


# Images: pixels, geometry, masks, features.

_V = "CAST(least(255, greatest(0, floor((e[(p + {o}) % 64 + 1]::DOUBLE + 0.4) * 320))) AS INTEGER)"
_IMAGES = "img AS (SELECT vec_id AS image_id, label AS class, " + ", ".join(f"list_transform(range(64), lambda p: {_V.format(o=o).replace('e[', 'embedding[')}) AS {c}" for c, o in (("bb", 0), ("gg", 21), ("rr", 42))) + " FROM embeddings)"
_PIXELS = _IMAGES + ", pix AS (SELECT image_id, class, (p // 8)::INTEGER AS y, (p % 8)::INTEGER AS x, p, bb[p + 1] AS b, gg[p + 1] AS g, rr[p + 1] AS r, bb, gg, rr FROM img, (SELECT unnest(range(64)) AS p))"
_OUT = "image_id, class, y, x, b, g, r"


def _pixels(spark: SparkSession, d: str, kernel: Callable | None = None) -> DataFrame:
    images = embeddings_as_images(spark, d)
    return pixels.pixels(images if kernel is None else kernels.map_kernel(images, kernel))


@_query(f"WITH {_PIXELS} SELECT {_OUT} FROM pix")
def q_image_pixels(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d)


@_query(f"WITH {_PIXELS} SELECT image_id, class, y, (7 - x)::INTEGER AS x, b, g, r FROM pix")
def q_flip(spark: SparkSession, d: str) -> DataFrame:
    return pixels.flipped(pixels.pixels(embeddings_as_images(spark, d), sized=True)).select("image_id", "class", "y", "x", "b", "g", "r")


@_query(f"WITH {_PIXELS} SELECT image_id, class, y, (7 - x)::INTEGER AS x, b, g, r FROM pix")
def q_flip_kernel(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d, kernels.flip)


def _sampled(sx: str, sy: str, size: tuple[int, int, int, int] = (0, 8, 0, 8)) -> str:
    """SQL of an image sampled at (sx, sy); outside the part (x from, to, y from, to) is white."""
    x0, x1, y0, y1 = size
    at = lambda c, dy, dx: f"CASE WHEN x0 + {dx} >= {x0} AND x0 + {dx} < {x1} AND y0 + {dy} >= {y0} AND y0 + {dy} < {y1} THEN {c}[CAST((y0 + {dy}) * 8 + x0 + {dx} AS BIGINT) + 1]::DOUBLE ELSE 255.0::DOUBLE END"
    value = lambda c: f"CAST(floor((1 - fy) * ((1 - fx) * ({at(c, 0, 0)}) + fx * ({at(c, 0, 1)})) + fy * ((1 - fx) * ({at(c, 1, 0)}) + fx * ({at(c, 1, 1)})) + 0.5) AS INTEGER)"
    return f"""WITH {_PIXELS}, s AS (SELECT *, {sx} AS sx, {sy} AS sy FROM (SELECT *, x::DOUBLE AS xd, y::DOUBLE AS yd FROM pix)),
f AS (SELECT *, floor(sx) AS x0, floor(sy) AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM s)
SELECT image_id, class, y, x, {value('bb')} AS b, {value('gg')} AS g, {value('rr')} AS r FROM f"""


def _mapped(m: list[list[float]]) -> str:
    n = lambda v: f"({v!r})::DOUBLE"
    line = lambda k: f"({n(m[k][0])} * xd + {n(m[k][1])} * yd + {n(m[k][2])})"
    return _sampled(f"{line(0)} / {line(2)}", f"{line(1)} / {line(2)}")


#: Inverse maps of 8 by 8 pixels (a turn by 25 degrees, a shear by 0.2 and -0.1, a skew by 0.2 and -0.3), and the weights of a blur of 9.
_ROTATION = [[0.9063077870366499, -0.42261826174069944, 2.065241898816198], [0.42261826174069944, 0.90630778703665, -1.3157041951093977], [0.0, 0.0, 1.0]]
_SHEARING = [[0.9803921568627451, -0.19607843137254902, 0.0], [0.09803921568627451, 0.9803921568627451, 0.0], [0.0, 0.0, 1.0]]
_SKEWING = [[0.8999999999999999, 0.15000000000000002, -0.19999999999999976], [-0.1, 1.1500000000000001, -0.2000000000000002], [-0.024999999999999998, 0.03749999999999999, 0.9499999999999998]]
_WEIGHTS = [0.014839453814831463, 0.04981728920101665, 0.11832250618647215, 0.198828996548082, 0.23638350849919545, 0.198828996548082, 0.11832250618647215, 0.04981728920101665, 0.014839453814831463]


@_query(_mapped(_ROTATION))
def q_rotate(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d, lambda image: kernels.rotate(image, 25.0))


@_query(_mapped(_SHEARING))
def q_shear(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d, lambda image: kernels.shear(image, 0.2, -0.1))


@_query(_mapped(_SKEWING))
def q_skew(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d, lambda image: kernels.skew(image, 0.2, -0.3))


_PULL = "(0.2::DOUBLE * (((xd - 4) * (xd - 4) + (yd - 4) * (yd - 4)) / 32.0::DOUBLE))"


@_query(_sampled(f"xd + (xd - 4) * {_PULL}", f"yd + (yd - 4) * {_PULL}"))
def q_distortion(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d, lambda image: kernels.distortion(image, 0.2))


@_query(_sampled("2 + least(greatest((xd + 0.5::DOUBLE) * 0.75::DOUBLE - 0.5::DOUBLE, 0), 5)", "1 + least(greatest((yd + 0.5::DOUBLE) * 0.75::DOUBLE - 0.5::DOUBLE, 0), 5)"))
def q_crop(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d, lambda image: kernels.crop(image, 0.75, top=1, left=2))


def _blur_sql() -> str:
    weights = [f"({w!r})::DOUBLE" for w in _WEIGHTS]
    mirror = lambda v: f"(CASE WHEN abs({v}) > 7 THEN 14 - abs({v}) ELSE abs({v}) END)"
    across = lambda c: "list_transform(range(64), lambda p: " + " + ".join(f"{w} * {c}[p // 8 * 8 + {mirror(f'(p % 8 + {k - 4})')} + 1]" for k, w in enumerate(weights)) + ")"
    down = lambda c: "CAST(floor(" + " + ".join(f"{w} * {c}[{mirror(f'(y + {k - 4})')} * 8 + x + 1]" for k, w in enumerate(weights)) + " + 0.5) AS INTEGER)"
    return f"WITH {_IMAGES}, a AS (SELECT image_id, class, {across('bb')} AS bb, {across('gg')} AS gg, {across('rr')} AS rr FROM img), p AS (SELECT *, (p // 8)::INTEGER AS y, (p % 8)::INTEGER AS x FROM a, (SELECT unnest(range(64)) AS p)) SELECT image_id, class, y, x, {down('bb')} AS b, {down('gg')} AS g, {down('rr')} AS r FROM p"


@_query(_blur_sql())
def q_gaussian_blur(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d, kernels.blur)


_HSV = _PIXELS + """, m AS (SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS dd FROM pix),
q AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE round_even(1044480.0::DOUBLE / v, 0)::BIGINT END AS sd, CASE WHEN dd = 0 THEN 0 ELSE round_even(737280.0::DOUBLE / (6.0::DOUBLE * dd), 0)::BIGINT END AS hd FROM m),
t AS (SELECT *, floor((dd * sd + 2048) / 4096.0::DOUBLE)::INTEGER AS s, floor((CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * dd ELSE r - g + 4 * dd END * hd + 2048) / 4096.0::DOUBLE)::INTEGER AS h0 FROM q),
hsv AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END AS h FROM t),
raw AS (SELECT *, v > 25 AND s > 25 AND h <= 95 AS leaf FROM hsv)"""


@_query(f"WITH {_HSV} SELECT image_id, y, x, h, s, v FROM hsv")
def q_hsv(spark: SparkSession, d: str) -> DataFrame:
    return pixels.with_hsv(_pixels(spark, d)).select("image_id", "y", "x", "h", "s", "v")


_LINE = lambda c: f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow(({c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"
_CUBE = lambda t: f"CASE WHEN {t} > 0.008856 THEN pow({t}, {1 / 3!r}::DOUBLE) ELSE 7.787::DOUBLE * {t} + {16 / 116!r}::DOUBLE END"
_BYTE = lambda c: f"greatest(0, least(255, floor({c} + 0.5::DOUBLE)))::INTEGER"
_LAB = f"""li AS (SELECT *, {_LINE('b')} AS lb, {_LINE('g')} AS lg, {_LINE('r')} AS lr FROM raw),
xyz AS (SELECT *, (0.412453::DOUBLE * lr + 0.357580::DOUBLE * lg + 0.180423::DOUBLE * lb) / 0.950456::DOUBLE AS xx, 0.212671::DOUBLE * lr + 0.715160::DOUBLE * lg + 0.072169::DOUBLE * lb AS yy, (0.019334::DOUBLE * lr + 0.119193::DOUBLE * lg + 0.950227::DOUBLE * lb) / 1.088754::DOUBLE AS zz FROM li),
fff AS (SELECT *, {_CUBE('xx')} AS fx, {_CUBE('yy')} AS fy, {_CUBE('zz')} AS fz FROM xyz),
lab AS (SELECT *, {_BYTE('(CASE WHEN yy > 0.008856 THEN 116 * fy - 16 ELSE 903.3::DOUBLE * yy END) * 255 / 100')} AS l, {_BYTE('500 * (fx - fy) + 128')} AS a_, {_BYTE('200 * (fy - fz) + 128')} AS b_ FROM fff)"""


@_query(f"WITH {_HSV}, {_LAB} SELECT image_id, y, x, l, a_, b_ FROM lab")
def q_lab(spark: SparkSession, d: str) -> DataFrame:
    return pixels.with_lab(_pixels(spark, d)).select("image_id", "y", "x", "l", "a_", "b_")


@_query(f"WITH {_HSV} SELECT image_id, y, x, leaf FROM raw")
def q_leaf_mask_raw(spark: SparkSession, d: str) -> DataFrame:
    return pixels.with_hsv(_pixels(spark, d)).select("image_id", "y", "x", pixels.is_leaf().alias("leaf"))


def _morph(source: str, name: str, how: str, offsets: list[tuple[int, int]]) -> str:
    """SQL of an erosion (AND) or dilation (OR) of lists of 64 cells; cells outside do not count."""
    cell = lambda dx, dy: f"CASE WHEN p % 8 + {dx} BETWEEN 0 AND 7 AND p // 8 + {dy} BETWEEN 0 AND 7 THEN l[p + {8 * dy + dx} + 1] ELSE {how == 'AND'} END"
    return f"{name} AS (SELECT image_id, list_transform(range(64), lambda p: {f' {how} '.join(cell(*o) for o in offsets)}) AS l FROM {source})"


_PLUS = [(0, -1), (-1, 0), (0, 0), (1, 0), (0, 1)]
_ELLIPSE = [(0, -2), (0, 2), *((dx, dy) for dy in (-1, 0, 1) for dx in range(-2, 3))]
_MASK = _HSV + ", raws AS (SELECT image_id, list(leaf ORDER BY p) AS l FROM raw GROUP BY 1), " + ", ".join([_morph("raws", "er1", "AND", _PLUS), _morph("er1", "op1", "OR", _PLUS), _morph("op1", "di1", "OR", _ELLIPSE), _morph("di1", "masks", "AND", _ELLIPSE)])
_MASK += ", mask AS (SELECT image_id, (p // 8)::INTEGER AS y, (p % 8)::INTEGER AS x, p, l[p + 1] AS leaf FROM masks, (SELECT unnest(range(64)) AS p))"


def _on(spark: SparkSession, d: str, mask_of: Callable) -> DataFrame:
    return pixels.pixels(embeddings_as_images(spark, d), mask_of)


@_query(f"WITH {_MASK} SELECT image_id, y, x, leaf AS \"on\" FROM mask")
def q_leaf_mask(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, kernels.leaf_mask).select("image_id", "y", "x", "on")


@_query(f"WITH {_MASK} SELECT image_id, class, y, x, " + ", ".join(f"CASE WHEN mask.leaf THEN {c} ELSE 0 END AS {c}" for c in "bgr") + " FROM pix JOIN mask USING (image_id, y, x, p)")
def q_masked_image(spark: SparkSession, d: str) -> DataFrame:
    return pixels.masked(_on(spark, d, kernels.leaf_mask), F.col("on")).drop("on")


_OBJECTS = _MASK.replace("WITH ", "") + """, pad AS (SELECT image_id, y, x FROM (SELECT DISTINCT image_id FROM mask), (SELECT unnest(range(-1, 9)) AS y), (SELECT unnest(range(-1, 9)) AS x)),
bg AS (SELECT image_id, y, x FROM pad ANTI JOIN (SELECT image_id, y, x FROM mask WHERE leaf) USING (image_id, y, x)),
outside AS (SELECT image_id, -1 AS y, -1 AS x FROM (SELECT DISTINCT image_id FROM mask) UNION
  SELECT b.image_id, b.y, b.x FROM outside o, bg b WHERE b.image_id = o.image_id AND abs(b.x - o.x) + abs(b.y - o.y) = 1),
solid AS (SELECT image_id, y, x, (y * 8 + x)::INTEGER AS p FROM pad ANTI JOIN outside USING (image_id, y, x)),
reach AS (SELECT image_id, p AS object, p, y, x FROM solid UNION
  SELECT r.image_id, r.object, s.p, s.y, s.x FROM reach r, solid s WHERE s.image_id = r.image_id AND abs(s.x - r.x) <= 1 AND abs(s.y - r.y) <= 1),
member AS (SELECT image_id, p, any_value(y) AS y, any_value(x) AS x, min(object) AS object FROM reach GROUP BY 1, 2),
cells AS (SELECT image_id, object, cy, cx, count(*) AS n FROM (SELECT image_id, object, y - dy AS cy, x - dx AS cx FROM member, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(dy, dx)) GROUP BY ALL),
areas AS (SELECT image_id, object, sum(CASE n WHEN 4 THEN 1.0 WHEN 3 THEN 0.5 ELSE 0 END)::DOUBLE AS area FROM cells GROUP BY 1, 2),
objects AS (SELECT image_id, object, count(*) AS pixels, any_value(area) AS area FROM member JOIN areas USING (image_id, object) GROUP BY 1, 2),
top AS (SELECT image_id, object FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, object) AS nth FROM objects) WHERE nth = 1),
big AS (SELECT image_id, y, x FROM member JOIN top USING (image_id, object))"""


@_query(f"WITH RECURSIVE {_OBJECTS} SELECT o.image_id, label AS class, object, pixels, area FROM objects o JOIN embeddings ON vec_id = image_id")
def q_components(spark: SparkSession, d: str) -> DataFrame:
    return features.objects(embeddings_as_images(spark, d))


#: The border is followed pixel by pixel: ``d`` is the way from a point to the one before it, and of the eight ways that come
#: after it counter-clockwise the first that stays on the object is taken; a point is kept where the way changes, and the first.
_DX, _DY = "[1, 1, 0, -1, -1, -1, 0, 1]", "[0, -1, -1, -1, 0, 1, 1, 1]"
_ON = "(p % 8 + {dx}[{k} + 1] BETWEEN 0 AND 7 AND p // 8 + {dy}[{k} + 1] BETWEEN 0 AND 7 AND list_contains(l, (p // 8 + {dy}[{k} + 1]) * 8 + p % 8 + {dx}[{k} + 1]))"
_BORDER = _OBJECTS + f""", shape AS (SELECT image_id, object, list(p) AS l, object AS p FROM member GROUP BY ALL),
began AS (SELECT image_id, object, l, p, list_filter([4, 3, 2, 1, 0, 7, 6, 5], lambda k: {_ON.format(k='k', dx=_DX, dy=_DY)})[1] AS back FROM shape),
walk AS (SELECT image_id, object, l, 0 AS i, p, back AS d, p + 8 * {_DY}[back + 1] + {_DX}[back + 1] AS last, false AS done FROM began WHERE back IS NOT NULL UNION ALL
  SELECT image_id, object, l, i + 1, q, (k + 4) % 8, last, q = object AND p = last FROM (
    SELECT *, p + 8 * {_DY}[k + 1] + {_DX}[k + 1] AS q FROM (SELECT *, list_filter(list_transform(range(1, 9), lambda z: (d + z) % 8), lambda k: {_ON.format(k='k', dx=_DX, dy=_DY)})[1] AS k FROM walk WHERE NOT done))),
ways AS (SELECT image_id, object, i, p, (d + 4) % 8 AS came, lead((d + 4) % 8) OVER (PARTITION BY image_id, object ORDER BY i) AS went, done FROM walk),
kept AS (SELECT image_id, object, i, p FROM ways WHERE NOT done AND (i = 0 OR came <> went) UNION ALL SELECT image_id, object, 0, object FROM began WHERE back IS NULL)"""


@_query(f"""WITH RECURSIVE {_BORDER} SELECT image_id, label AS class, object::INTEGER AS object, (row_number() OVER (PARTITION BY image_id, object ORDER BY i) - 1)::INTEGER AS nth, (p % 8)::INTEGER AS x, (p // 8)::INTEGER AS y
FROM kept JOIN embeddings ON vec_id = image_id""")
def q_contours(spark: SparkSession, d: str) -> DataFrame:
    return features.contours(embeddings_as_images(spark, d))


@_query(f"WITH RECURSIVE {_OBJECTS} SELECT image_id, y::INTEGER AS y, x::INTEGER AS x FROM big")
def q_largest_leaf(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, features.largest_mask).where("on").select("image_id", "y", "x")


_BOX = "box AS (SELECT image_id, count(*) AS area, min(x)::INTEGER AS x, min(y)::INTEGER AS y, (max(x) - min(x) + 1)::INTEGER AS width, (max(y) - min(y) + 1)::INTEGER AS height, sum(x)::BIGINT AS sum_x, sum(y)::BIGINT AS sum_y FROM big GROUP BY 1)"


@_query(f"WITH RECURSIVE {_OBJECTS}, {_BOX} SELECT * FROM box")
def q_bbox(spark: SparkSession, d: str) -> DataFrame:
    return features.sizes(embeddings_as_images(spark, d)).select("image_id", "area", "x", "y", "width", "height", "sum_x", "sum_y")


@_query(f"""WITH RECURSIVE {_OBJECTS}, {_BOX}, met AS (SELECT DISTINCT m.image_id, m.object FROM member m, box WHERE m.image_id = box.image_id AND m.x BETWEEN box.x AND box.x + width - 1 AND m.y BETWEEN box.y AND box.y + height - 1),
green AS (SELECT image_id, y, x FROM member JOIN met USING (image_id, object)),
o AS (SELECT p.*, gr.image_id IS NOT NULL AS green, p.x BETWEEN box.x - 1 AND box.x + width AND p.y BETWEEN box.y - 1 AND box.y + height
  AND NOT (p.x > box.x + 1 AND p.x < box.x + width - 2 AND p.y > box.y + 1 AND p.y < box.y + height - 2) AS blue FROM pix p JOIN box ON p.image_id = box.image_id LEFT JOIN green gr ON gr.image_id = p.image_id AND gr.y = p.y AND gr.x = p.x)
SELECT image_id, class, y, x, CASE WHEN blue THEN 255 WHEN green THEN 0 ELSE b END AS b, CASE WHEN blue THEN 0 WHEN green THEN 255 ELSE g END AS g, CASE WHEN blue OR green THEN 0 ELSE r END AS r FROM o""")
def q_roi_overlay(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d, lambda image: kernels.roi(kernels.Leaf(image)))


@_query(f"""WITH RECURSIVE {_OBJECTS}, {_LAB}, held AS (SELECT lab.* FROM lab JOIN big USING (image_id, y, x)), total AS (SELECT image_id, count(*) AS total FROM held GROUP BY 1),
long AS ({' UNION ALL '.join(f"SELECT image_id, '{n}' AS channel, {c} AS intensity FROM held" for n, c in pixels.CHANNELS.items())}), counts AS (SELECT image_id, channel, intensity, count(*) AS n FROM long GROUP BY 1, 2, 3)
SELECT image_id, channel, intensity::INTEGER AS intensity, coalesce(n, 0) / total * 100 AS pct FROM (SELECT * FROM total, (SELECT unnest({list(pixels.CHANNELS)}) AS channel), (SELECT unnest(range(256)) AS intensity)) LEFT JOIN counts USING (image_id, channel, intensity)""")
def q_channel_histogram(spark: SparkSession, d: str) -> DataFrame:
    return features.histograms(embeddings_as_images(spark, d))


@_query(f"WITH RECURSIVE {_OBJECTS}, {_BOX} SELECT image_id, area, x, y, width, height, sum_x / area AS centre_x, sum_y / area AS centre_y, x > 0 AND y > 0 AND x + width < 8 AND y + height < 8 AS in_frame FROM box")
def q_size_traits(spark: SparkSession, d: str) -> DataFrame:
    return features.sizes(embeddings_as_images(spark, d)).select("image_id", "area", "x", "y", "width", "height", "centre_x", "centre_y", "in_frame")


@_query()
def q_shape_traits(spark: SparkSession, d: str) -> DataFrame:
    return features.traits(embeddings_as_images(spark, d))


_BANDS = "tops AS (SELECT image_id, min(y) AS top, max(y) - min(y) + 1 AS h FROM big GROUP BY 1), bands AS (SELECT image_id, ((y - top) * 20) // h AS band, min(x)::INTEGER AS left_x, max(x)::INTEGER AS right_x, (sum(x) // count(*))::BIGINT AS centre_x, (sum(y) // count(*))::BIGINT AS centre_y FROM big JOIN tops USING (image_id) GROUP BY 1, 2)"


@_query(f"WITH RECURSIVE {_OBJECTS}, {_BANDS} SELECT image_id, band::INTEGER AS band, left_x, right_x, centre_x, centre_y FROM bands")
def q_pseudolandmarks(spark: SparkSession, d: str) -> DataFrame:
    return features.landmark_bands(embeddings_as_images(spark, d)).drop("class")


@_query(f"""WITH RECURSIVE {_OBJECTS}, {_BANDS}, points AS (SELECT image_id, 1 AS z, left_x AS px, centre_y AS py FROM bands UNION ALL SELECT image_id, 2, right_x, centre_y FROM bands UNION ALL SELECT image_id, 3, centre_x, centre_y FROM bands),
hit AS (SELECT p.image_id, p.y, p.x, max(z) AS z FROM pix p JOIN points q ON p.image_id = q.image_id AND (p.x - px) * (p.x - px) + (p.y - py) * (p.y - py) <= 25 GROUP BY 1, 2, 3)
SELECT image_id, class, y, x, CASE z WHEN 1 THEN 255 WHEN 2 THEN 255 WHEN 3 THEN 0 ELSE b END AS b, CASE z WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 79 ELSE g END AS g, CASE z WHEN 1 THEN 0 WHEN 2 THEN 255 WHEN 3 THEN 255 ELSE r END AS r
FROM pix LEFT JOIN hit USING (image_id, y, x) WHERE image_id IN (SELECT image_id FROM big)""")
def q_landmark_overlay(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d, lambda image: features.landmark_image(kernels.Leaf(image)))


#: Fixed values of the generated test image: the codes of its cells row by row, and colours as blue, green and red.
_CODES = """
3, 0, 0, 1, 1, 0, 0, 0, 0, 0, 1, 1, 1, 1, 0, 0, 0, 1, 1, 2, 1, 1, 1, 0, 1, 1, 2, 2, 2, 1, 1, 1,
1, 1, 1, 2, 1, 1, 1, 0, 0, 1, 1, 2, 1, 1, 0, 0, 0, 0, 1, 2, 1, 0, 0, 0, 0, 0, 0, 4, 0, 0, 0, 0
"""
_COLOURS = {1: (78, 184, 106), 2: (32, 96, 45), 3: (48, 64, 208), 4: (48, 90, 138)}
_LIGHT, _DARK, _LINES = (248, 248, 248), (235, 230, 222), (200, 198, 192)


def _test_image_sql(size: int = 400) -> str:
    cell = size // 8
    code = f"[{_CODES}][(y // {cell}) * 8 + x // {cell} + 1]"
    lines = ", ".join(str(min(k * cell, size - 1)) for k in range(9))
    channel = lambda k: f"CASE WHEN x IN ({lines}) OR y IN ({lines}) THEN {_LINES[k]} " + " ".join(f"WHEN code = {n} THEN {c[k]}" for n, c in _COLOURS.items()) + f" WHEN (x // {cell} + y // {cell}) % 2 = 0 THEN {_DARK[k]} ELSE {_LIGHT[k]} END"
    return f"SELECT y::INTEGER AS y, x::INTEGER AS x, {channel(0)} AS b, {channel(1)} AS g, {channel(2)} AS r FROM (SELECT y, x, {code} AS code FROM (SELECT unnest(range({size})) AS y), (SELECT unnest(range({size})) AS x))"


@_query(_test_image_sql(), fixed=True)
def q_test_image(spark: SparkSession, d: str) -> DataFrame:
    return test_image(spark)


_SWEPT = [
    ("Rotate", "angle", -180.0, 1.0, 360), ("Skew", "skx", -0.4, 0.01, 80), ("Skew", "sky", -0.4, 0.01, 80), ("Shear", "kx", -0.5, 0.01, 100),
    ("Shear", "ky", -0.5, 0.01, 100), ("Crop", "scale", 0.1, 0.01, 90), ("Distortion", "k", 0.0, 0.01, 50),
]


@_query(" UNION ALL ".join(f"SELECT '{m}' AS method, '{name}' AS name, {lo}::DOUBLE + k * {step}::DOUBLE AS value FROM (SELECT unnest(range({n + 1})) AS k)" for m, name, lo, step, n in _SWEPT), fixed=True)
def q_parameter_sweep(spark: SparkSession, d: str) -> DataFrame:
    return drawplan.sweep(spark)


def _image_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    images = embeddings_as_images(spark, d).withColumn("name", F.concat(F.lit("v"), F.col("image_id").cast("string"), F.lit(".png")))
    return images.select("class", "name", F.col("data").alias("content")), images


#: Payloads made of vectors: whole files, cut ones, one with a bit turned over, text, nothing and null.
_BROKEN = ["whole png", "whole jpeg", "whole bmp", "cut png", "cut jpeg", "cut bmp", "turned png", "text", "empty", "null"]


def payload(image: np.ndarray, how: str) -> bytes | None:
    kind = how.rpartition(" ")[2]
    if f".{kind}" not in sinks.ENCODERS:
        return {"text": b"no image at all", "empty": b"", "null": None}[how]
    data = sinks.ENCODERS[f".{kind}"](image)
    if how.startswith("cut"):
        return data[: len(data) // 2 if kind != "jpeg" else -2]
    return data if how.startswith("whole") else data[:20] + bytes([data[20] ^ 1]) + data[21:]


@_query("""
SELECT vec_id AS image_id, CASE WHEN k IN (0, 3, 6) THEN 'png' WHEN k IN (1, 4) THEN 'jpeg' WHEN k IN (2, 5) THEN 'bmp' END AS kind, CASE WHEN k < 3 THEN 8 END::INTEGER AS width,
  CASE WHEN k < 3 THEN 8 END::INTEGER AS height, 1::INTEGER AS orientation, CASE WHEN k < 3 THEN NULL WHEN k < 6 THEN 'cut short' WHEN k = 6 THEN 'damaged' WHEN k = 7 THEN 'unknown kind' ELSE 'empty' END AS reason
FROM (SELECT vec_id, vec_id % 10 AS k FROM embeddings)""")
def q_rejected_payloads(spark: SparkSession, d: str) -> DataFrame:
    def work(image: np.ndarray, row: dict) -> Iterator[dict]:
        yield {"content": payload(image, _BROKEN[row["image_id"] % 10])}

    return told(kernels.map_images(embeddings_as_images(spark, d), work, "content binary"), "content", ("image_id",))


@_query()
def q_compose_augment(spark: SparkSession, d: str) -> DataFrame:
    files, images = _image_files(spark, d)
    made = jobs.make(jobs.plan_outputs(files, n=2), images)
    return made.select("class", "name", "output", "methods", F.sha2("data", 256).alias("sha256"))


@_query()
def q_balance_images(spark: SparkSession, d: str) -> DataFrame:
    files, images = _image_files(spark, d)
    made = jobs.make(jobs.plan_outputs(files), images)
    return made.select("class", "name", "output", F.sha2("data", 256).alias("sha256"))


@_query()
def q_transform_all(spark: SparkSession, d: str) -> DataFrame:
    return features.transform_all(embeddings_as_images(spark, d)).select("image_id", "transform", F.sha2("data", 256).alias("sha256"))


@_query()
def q_contact_sheets(spark: SparkSession, d: str) -> DataFrame:
    sheets = features.contact_sheets(embeddings_as_images(spark, d), columns=3, cell=5, gap=1)
    return sheets.select("image_id", "height", "width", F.sha2("data", 256).alias("sha256"))
