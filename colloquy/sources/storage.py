"""Object-store settings from environment variables."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import SparkSession

DEFAULT_REGION = "us-east-1"


def s3_options(env: Mapping[str, str] | None = None) -> dict[str, str]:
    """Hadoop S3A settings; endpoint and region only if an endpoint is given."""
    env = os.environ if env is None else env
    key = env.get("AWS_ACCESS_KEY_ID") or env.get("STORAGE_ACCOUNT")
    secret = env.get("AWS_SECRET_ACCESS_KEY") or env.get("STORAGE_KEY")
    endpoint = env.get("AWS_ENDPOINT_URL") or env.get("STORAGE_URL")
    options = {}
    if key:
        options["fs.s3a.access.key"] = key
    if secret:
        options["fs.s3a.secret.key"] = secret
    if endpoint:
        options["fs.s3a.endpoint"] = endpoint
        options["fs.s3a.endpoint.region"] = env.get("AWS_REGION", DEFAULT_REGION)
    return options


def configure_s3(spark: SparkSession, env: Mapping[str, str] | None = None) -> None:
    """Put the settings on the session's Hadoop configuration."""
    target = spark.sparkContext._jsc.hadoopConfiguration()
    for name, value in s3_options(env).items():
        target.set(name, value)


def hadoop_uri(uri: str) -> str:
    """The form of an ``s3://`` address that the S3A file system reads."""
    return "s3a://" + uri[len("s3://") :] if uri.startswith("s3://") else uri


def write_text(spark: SparkSession, uri: str, text: str) -> None:
    """Write one small file with a given name through the Hadoop file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(hadoop_uri(uri))
    # A file system object of its own: without a checksum file, so that other programs may edit
    # the file later, and without a change to what other writers use.
    fs = hadoop.FileSystem.newInstance(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        fs.setWriteChecksum(False)
        stream = fs.create(path, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
    finally:
        fs.close()


def exists(spark: SparkSession, uri: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(hadoop_uri(uri))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(path)
