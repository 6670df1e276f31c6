"""Point clouds and id maps as other tools expect them: annotated, coloured by cluster, as rows of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Value of the constant spherical harmonic.
CONSTANT = 0.28209479177387814
#: Columns that colours by cluster take the place of.
REPLACED = ("cls", "red", "green", "blue", "alpha", "label", "segment")


def unit_colours(points: DataFrame) -> DataFrame:
    """Colours of 0 to 255 as 0 to 1."""
    return points.withColumns({c: F.col(c) / 255.0 for c in ("red", "green", "blue")})


def annotated(points: DataFrame, labels: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """Points with their cluster as ``cls``, in place of one they had; points without one are -1."""
    named = labels.select(F.col(key).alias("_of"), F.col(label).cast("int").alias("cls"))
    return points.drop("cls").join(named, F.col(key) == F.col("_of"), "left").drop("_of").fillna(-1, ["cls"])


def segmented(points: DataFrame, palette: list[tuple[int, int, int]], keep_harmonics: bool = False, minimal: list[str] | None = None) -> DataFrame:
    """Points coloured by cluster: ``cls``, red, green and blue come last.

    The colour is the palette's at the cluster modulo its length.  Unless
    harmonics are kept, the constant ones show that colour and the others are 0.
    ``minimal`` names the only other columns to stay.
    """
    at = F.pmod(F.col("cls").cast("int"), F.lit(len(palette)))
    colour = [F.get(F.array(*(F.lit(c[i]) for c in palette)), at) for i in range(3)]
    stay = [c for c in points.columns if c not in REPLACED and (minimal is None or c in minimal)]
    bake = not keep_harmonics and all(f"f_dc_{i}" in stay for i in range(3))

    def kept(c: str):
        if bake and c in ("f_dc_0", "f_dc_1", "f_dc_2"):
            return ((colour[int(c[-1])] / 255.0 - 0.5) / CONSTANT).alias(c)
        return F.lit(0.0).cast(points.schema[c].dataType).alias(c) if bake and c.startswith("f_rest_") else F.col(c)

    return points.select(*map(kept, stay), F.col("cls").cast("float").alias("cls"), *(v.cast("short").alias(n) for v, n in zip(colour, ("red", "green", "blue"), strict=True)))


def id_map_rows(pixels: DataFrame, image: list[str], height: int, width: int, k: str = "k") -> DataFrame:
    """``(image, y, bytes)``: every row of an id map as bytes, 0 where a pixel is missing; ids above 255 raise.

    Pixels are placed by the sums of their own shares, so a row is put together
    from one aggregate of at most ``width`` of them.
    """
    grid = pixels.select(*image).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    id_ = F.when(F.col(k) <= 255, F.col(k)).otherwise(F.raise_error(F.lit("an id above 255 fits no byte")))
    rows = pixels.groupBy(*image, F.col("y").alias("_y")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("x").cast("int"), F.lpad(F.hex(id_.cast("long")), 2, "0")))).alias("m"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in image]
    rows = rows.select(*(F.col(c).alias(f"_{c}") for c in image), "_y", "m")
    whole = grid.join(rows, [*on, F.col("y") == F.col("_y")], "left")
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.coalesce(F.try_element_at("m", x), F.lit("00"))), "")
    return whole.select(*image, "y", F.unhex(text).alias("bytes"))
