"""Column lists of the shared tables."""

from pyspark.sql import types as T

# Columns of the result table in output order.
STATS = T.StructType(
    [
        T.StructField("image_date", T.TimestampNTZType()),
        T.StructField("image_barcode", T.StringType()),
        T.StructField("image_barcode_read", T.StringType()),
        T.StructField("image_path", T.StringType()),
        T.StructField("image_total_area", T.DoubleType()),
        T.StructField("image_total_length", T.DoubleType()),
        T.StructField("image_new_area", T.DoubleType()),
        T.StructField("image_new_parts", T.DoubleType()),
        T.StructField("image_area_change", T.DoubleType()),
        T.StructField("plant_id", T.IntegerType()),
        T.StructField("plant_center_x", T.DoubleType()),
        T.StructField("plant_center_y", T.DoubleType()),
        T.StructField("plant_green_area", T.DoubleType()),
        T.StructField("plant_root_count", T.DoubleType()),
        T.StructField("plant_total_length", T.DoubleType()),
        T.StructField("plant_total_length_RGR", T.DoubleType()),
        T.StructField("plant_main_root_depth", T.DoubleType()),
        T.StructField("plant_main_root_length", T.DoubleType()),
        T.StructField("plant_main_root_length_RGR", T.DoubleType()),
        T.StructField("root_source", T.StringType()),
        T.StructField("rsml_plant_id", T.StringType()),
    ]
)

AXES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("root_index", T.IntegerType()),
        T.StructField("parent_index", T.IntegerType()),
        T.StructField("plant_index", T.IntegerType()),
        T.StructField("plant_id", T.StringType()),
        T.StructField("root_id", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("points", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("n_plants", T.IntegerType()),
        T.StructField("unit", T.StringType()),
        T.StructField("resolution", T.DoubleType()),
        T.StructField("image_name", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)

TILES = T.StructType(
    [
        T.StructField("image_id", T.StringType()),
        T.StructField("ty", T.IntegerType()),
        T.StructField("tx", T.IntegerType()),
        T.StructField("y0", T.IntegerType()),
        T.StructField("x0", T.IntegerType()),
        T.StructField("h", T.IntegerType()),
        T.StructField("w", T.IntegerType()),
        T.StructField("halo_top", T.IntegerType()),
        T.StructField("halo_left", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
    ]
)
