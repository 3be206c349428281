"""Names shared by all tables.

Fixed values: the label order is the column order of every wide result, the suffix and plane names
are the on-disk names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

LABELS = (
    "ACL", "MCL", "Medial Meniscus", "Lateral Meniscus", "Medial OA", "Lateral OA", "PF OA",
    "Effusion", "Synovitis", "Baker's", "Contusion", "Fracture",
)
TRUE_FLAG = "__true"
PLANES = ("sagittal", "coronal", "axial")
TYPICAL_SLICES = 30

# Names of the input columns in CSV tables.
CASE_COLUMN = "StudyInstanceUID"
REPORT_COLUMN = "Report"
SERIES_COLUMN = "SeriesInstanceUID"
PLANE_COLUMN = "Anatomical_Plane"
FLUID_COLUMN = "Fluid_Sensitive"
FATSAT_COLUMN = "Fat_Suppression"


@dataclass(frozen=True)
class Columns:
    """How an input table names its id, text and label columns."""

    case_id: str = CASE_COLUMN
    report: str = REPORT_COLUMN
    labels: tuple[str, ...] = LABELS


def case_schema(columns: Columns = Columns()) -> T.StructType:
    """Labels are read as text, so blanks and sentinels reach `known_label` instead of failing the scan."""
    names = (columns.case_id, columns.report, *columns.labels)
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


SERIES_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in
                              (CASE_COLUMN, SERIES_COLUMN, FLUID_COLUMN, FATSAT_COLUMN, PLANE_COLUMN)])

HEADER_SCHEMA = T.StructType([
    T.StructField("case_id", T.StringType()), T.StructField("series_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("instance_number", T.IntegerType()),
    T.StructField("position", T.ArrayType(T.DoubleType())),
    T.StructField("orientation", T.ArrayType(T.DoubleType())),
    T.StructField("pixel_spacing", T.ArrayType(T.DoubleType())),
    T.StructField("slice_thickness", T.DoubleType()),
    T.StructField("rows", T.IntegerType()), T.StructField("cols", T.IntegerType()),
    T.StructField("transfer_syntax", T.StringType()),
    T.StructField("series_description", T.StringType()),
])
