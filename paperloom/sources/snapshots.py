"""Numbered folders of a table, complete once Spark wrote ``_SUCCESS``."""

from pyspark.sql import SparkSession


def versions(spark: SparkSession, root: str, kind: str) -> list[int]:
    """Numbers of the completed folders ``root/kind=N``, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{kind}=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)
