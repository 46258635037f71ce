"""Column lists and types shared by all modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The standard feature vector of a facet, in order.
FEATURES = [
    "glcm_contrast", "glcm_dissimilarity", "glcm_homogeneity", "glcm_energy", "glcm_correlation",
    "lbp_entropy", "lbp_uniformity", "sobel_mean", "laplacian_mean", "laplacian_std", "edge_density",
]

#: The vector used for ranking, and the part of it that makes the composite.
RANKING_FEATURES = ["lbp_mean", "lbp_std", "lbp_entropy", "glcm_contrast", "glcm_dissimilarity", "glcm_homogeneity", "glcm_energy", "glcm_correlation"]
COMPOSITE_FEATURES = ["lbp_entropy", "glcm_contrast", "glcm_dissimilarity", "glcm_homogeneity", "glcm_energy", "glcm_correlation"]
#: Composite features that are better when lower.
LOWER_IS_BETTER = ["lbp_entropy", "glcm_contrast", "glcm_dissimilarity"]

#: Facets of the dish, row by row.
ROW_SIZES = [9, 11, 13, 15, 17, 17, 17, 17, 17, 17, 17, 17, 17, 15, 13, 11, 9]

CALIBRATION = T.StructType([
    T.StructField("calib_img", T.StringType()),
    T.StructField("mirror_ids", T.MapType(T.StringType(), T.ArrayType(T.ArrayType(T.IntegerType())))),
])
ANNOTATIONS = T.StructType([T.StructField("file", T.StringType()), T.StructField("marked_mirrors", T.ArrayType(T.IntegerType()))])


def real(c: Column | str) -> Column:
    """NaN as NULL: the one rule for missing numbers in this library."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def observations(df: DataFrame, features: list[str]) -> DataFrame:
    """A feature table whose features are doubles without NaN."""
    return df.withColumns({f: real(F.col(f).cast("double")) for f in features})


def long(df: DataFrame, keys: list[str], features: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """One row per key and feature."""
    return df.unpivot(keys, features, name, value)
