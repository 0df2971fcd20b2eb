"""Annotation documents to three tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.session import stored

IMAGE = "struct<id:bigint,file_name:string,width:int,height:int>"
ANNOTATION = "struct<id:bigint,image_id:bigint,category_id:int,area:double,bbox:array<double>,iscrowd:int,segmentation:struct<size:array<int>,counts:array<int>>>"
CATEGORY = "struct<id:int,name:string>"
SCHEMA = f"images array<{IMAGE}>, annotations array<{ANNOTATION}>, categories array<{CATEGORY}>"


def read_coco(spark: SparkSession, path, one_per_line=False):
    """Images, annotations and categories of one document or a folder of shards.

    A fixed schema avoids an inference pass. Large collections should be stored
    as many documents (or one per line) so that reading is parallel.
    """
    return explode_documents(spark.read.schema(SCHEMA).option("multiLine", not one_per_line).json(path))


def parse_coco(documents: DataFrame, column: str):
    """The same from a text column of JSON documents, each parsed once for all three tables."""
    return explode_documents(stored(documents.select(F.from_json(column, SCHEMA).alias("_d")).select("_d.*"), "documents"))


def explode_documents(documents: DataFrame):
    images = documents.select(F.inline("images")).withColumnRenamed("id", "image_id")
    annotations = documents.select(F.inline("annotations")).withColumnRenamed("id", "annotation_id")
    categories = documents.select(F.inline("categories")).withColumnRenamed("id", "category_id")
    return images, annotations, categories
