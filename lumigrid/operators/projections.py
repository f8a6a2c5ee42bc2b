"""Row-wise operators on pixels: channels, geometry, colour spaces and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigrid.model import CHANNELS, COLOUR, NORMAL, POSITION, Camera

#: Fixed values of the sRGB to CIE Lab conversion (D65 white).
SRGB = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
WHITE = (95.047, 100.0, 108.883)
#: Fixed values of the conversion without gamma (BT.709).
BT709 = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
BT709_WHITE = (0.950456, 1.0, 1.088754)
CUT = 0.008856


def assembled(rgb: DataFrame, depth: DataFrame, normals: DataFrame | None = None) -> DataFrame:
    """Nine channels from frames of colour (0 to 255), position and normals."""
    keys = ["image_id", "row", "col"]
    out = rgb.select(*keys, *[(F.col(c) / 255).alias(c) for c in COLOUR]).join(depth.select(*keys, *POSITION), keys)
    if normals is None:
        return out.select("*", *[F.lit(0.0).alias(n) for n in NORMAL])
    return out.join(normals.select(*keys, *NORMAL), keys)


def channels(df: DataFrame, *names: str) -> DataFrame:
    """The named channels with the pixels' keys; only they are read from a file."""
    return df.select("image_id", "pid", *names)


def number_of_pixels(df: DataFrame) -> DataFrame:
    return df.groupBy("image_id").agg(F.count("*").alias("n_pixels"))


def elements(df: DataFrame) -> DataFrame:
    """Each pixel's channels as one record of colour, distance and normal."""
    part = lambda names: F.struct(*[F.col(c).alias(a) for c, a in zip(names, "abc")])
    return df.select("image_id", "pid", F.struct(part(COLOUR).alias("color"), part(POSITION).alias("distance"), part(NORMAL).alias("normal")).alias("e"))


def from_elements(df: DataFrame) -> DataFrame:
    names = [(f, a) for f in ("color", "distance", "normal") for a in "abc"]
    return df.select("image_id", "pid", *[F.col(f"e.{f}.{a}").alias(c) for (f, a), c in zip(names, CHANNELS)])


def element_array(df: DataFrame) -> DataFrame:
    """Records as flat arrays of nine numbers, and back with ``element_fields``."""
    return df.select("image_id", "pid", F.array(*CHANNELS).alias("flat"))


def element_fields(df: DataFrame) -> DataFrame:
    return df.select("image_id", "pid", *[F.get("flat", F.lit(i)).alias(c) for i, c in enumerate(CHANNELS)])


def combined(df: DataFrame, sign: int = 1, prefix: str = "o_") -> DataFrame:
    """Component-wise sum or difference with the channels named ``o_*``; the normal is scaled to length 1,
    and is NaN where it is 0 (x - x)."""
    plain = {c: F.col(c) + sign * F.col(prefix + c) for c in CHANNELS}
    length = F.sqrt(sum((plain[n] * plain[n] for n in NORMAL), F.lit(0.0)))
    out = {c: (F.when(length != 0, plain[c] / F.when(length != 0, length)).otherwise(float("nan")) if c in NORMAL else plain[c]) for c in CHANNELS}
    return df.select("image_id", "pid", *[out[c].alias(c) for c in CHANNELS])


def zero(df: DataFrame) -> DataFrame:
    """The neutral element of the sum for each pixel, once for each pid: all channels 0."""
    return df.select("image_id", "pid").distinct().select("image_id", "pid", *[F.lit(0.0).alias(c) for c in CHANNELS])


def divided(df: DataFrame, by: float) -> DataFrame:
    length = F.sqrt(sum((F.col(n) * F.col(n) for n in NORMAL), F.lit(0.0)))
    return df.select("image_id", "pid", *[(F.col(c) / by).alias(c) for c in (*COLOUR, *POSITION)], *[(F.col(n) / F.when(length != 0, length)).alias(n) for n in NORMAL])


def depth_to_world(df: DataFrame, camera: Camera = Camera()) -> DataFrame:
    """World positions from depth; rows and columns count from 1."""
    return df.withColumns({"x": (F.col("col") - camera.cx) * F.col("z") / camera.fx, "y": (F.col("row") - camera.cy) * F.col("z") / camera.fy})


def to_colour_camera(df: DataFrame, camera: Camera = Camera()) -> DataFrame:
    """Where each world position stands in the colour camera: ``u`` (columns), ``v`` (rows) and its depth there ``w``."""
    r, t = camera.rotation(), camera.translation
    x, y, w = (sum((float(r[i][j]) * F.col(c) for j, c in enumerate(POSITION)), F.lit(t[i])) for i in range(3))
    return df.withColumns({"u": x / w * camera.f_rgb[0] + camera.c_rgb[0], "v": y / w * camera.f_rgb[1] + camera.c_rgb[1], "w": w})


def absolute_depth(df: DataFrame, raw: str = "raw", camera: Camera = Camera()) -> DataFrame:
    """``z`` in metres from the sensor's raw number, up to the greatest depth."""
    z = camera.depth_params[0] / (camera.depth_params[1] - F.col(raw))
    return df.withColumn("z", F.when((z < 0) | (z > camera.max_depth), camera.max_depth).otherwise(z))


def projection_mask(df: DataFrame, rows: tuple[int, int] = (45, 471), cols: tuple[int, int] = (41, 601)) -> DataFrame:
    return df.withColumn("inside", F.col("row").between(*rows) & F.col("col").between(*cols))


def _f(t: Column, exponent: float) -> Column:
    return F.when(t > CUT, F.pow(t, F.lit(exponent))).otherwise(7.787 * t + 16.0 / 116)


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """L, a, b of colours from 0 to 255."""

    def linear(v: Column) -> Column:
        v = v / 255
        return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92) * 100

    rgb = [linear(c) for c in (r, g, b)]
    x, y, z = (_f(sum((m * c for m, c in zip(row, rgb)), F.lit(0.0)) / w, 0.3333333333333333) for row, w in zip(SRGB, WHITE))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def to_lab(df: DataFrame) -> DataFrame:
    """Colours replaced by Lab, taken as if from 0 to 255 whatever their range."""
    lab = rgb_to_lab(*[F.col(c) for c in COLOUR])
    return df.withColumns(dict(zip(COLOUR, lab)))


def to_lab_image(df: DataFrame) -> DataFrame:
    """Lab without gamma; an image with a colour over 1 is divided by 255 as a whole."""
    top = df.groupBy("image_id").agg(F.max(F.greatest(*COLOUR)).alias("_top"))
    df = df.join(top, "image_id")
    rgb = [F.when(F.col("_top") > 1, F.col(c) / 255).otherwise(F.col(c)) for c in COLOUR]
    x, y, z = (sum((m * c for m, c in zip(row, rgb)), F.lit(0.0)) / w for row, w in zip(BT709, BT709_WHITE))
    fx, fy, fz = (_f(t, 1 / 3) for t in (x, y, z))
    light = F.when(y > CUT, 116 * F.pow(y, F.lit(1 / 3)) - 16).otherwise(903.3 * y)
    return df.withColumns({"c1": light, "c2": 500 * (fx - fy), "c3": 200 * (fy - fz)}).drop("_top")


def crop(df: DataFrame, margin: int = 15) -> DataFrame:
    """Drops rows and columns before ``margin`` and within ``margin`` of the end; counts anew from 1."""
    size = df.groupBy("image_id").agg(F.max("row").alias("_h"), F.max("col").alias("_w"))
    inner = df.join(size, "image_id").where(F.col("row").between(margin, F.col("_h") - margin) & F.col("col").between(margin, F.col("_w") - margin))
    height = F.col("_h") - 2 * margin + 1
    inner = inner.withColumns({"row": F.col("row") - (margin - 1), "col": F.col("col") - (margin - 1)})
    return inner.withColumn("pid", ((F.col("col") - 1) * height + F.col("row")).cast("long")).drop("_h", "_w")


def shifted_labels(df: DataFrame, by: int = 1, label: str = "label") -> DataFrame:
    return df.withColumn(label, (F.col(label) + by).cast("int"))


def scaled_features(df: DataFrame, weight: float = 1.0) -> DataFrame:
    """Colours and positions by the sum of their sample deviations over the image."""
    spread = lambda names: sum((F.stddev_samp(c) for c in names), F.lit(0.0))
    s = df.groupBy("image_id").agg((3 / spread(COLOUR)).alias("_c"), (weight * 3 / spread(POSITION)).alias("_p"))
    df = df.join(s, "image_id")
    return df.withColumns({**{c: F.col(c) * F.col("_c") for c in COLOUR}, **{c: F.col(c) * F.col("_p") for c in POSITION}}).drop("_c", "_p")


def painted(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Each pixel with the mean colour of its region."""
    means = regions.select("image_id", "label", *[F.col(f"m{c}").alias(f"p{c[1]}") for c in COLOUR])
    return df.select("image_id", "pid", "label").join(means, ["image_id", "label"])


def products(a: str, b: str, c: str) -> dict[str, Column]:
    """The six products of a Gaussian's sufficient statistic, negated."""
    pairs = ((a, a), (a, b), (a, c), (b, b), (b, c), (c, c))
    return {f"{p}_{q}": -F.col(p) * F.col(q) for p, q in pairs}


def watson_statistic(x: Column, y: Column, z: Column) -> tuple[Column, ...]:
    """Squares, then products times the root of 2."""
    r = F.sqrt(F.lit(2.0))
    return x * x, y * y, z * z, r * x * y, r * x * z, r * y * z


def sufficient_statistics(df: DataFrame) -> DataFrame:
    t = watson_statistic(*[F.col(n) for n in NORMAL])
    return df.withColumns({**products(*COLOUR), **products(*POSITION), **{f"t{i + 1}": x for i, x in enumerate(t)}})
