"""Raw and normalised events, read as batch or stream."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paperloom.functions.truth import text_or_null

RAW_SCHEMA = "source string, payload string, full_data string, ts timestamp, _corrupt_record string"
DOCUMENT_SCHEMA = (
    "doc_id string, source string, title string, content string, metadata string, "
    "_corrupt_record string"
)
PARSE_FAILED = "message is not valid JSON"


def read_raw_events(spark: SparkSession, path: str, *, stream: bool = False, **options) -> DataFrame:
    """One JSON object per line; a line that cannot be read keeps its text and an error."""
    reader = spark.readStream if stream else spark.read
    lines = reader.options(**options).text(path)
    return parse_messages(lines, "value", RAW_SCHEMA)


def parse_messages(df: DataFrame, body: str, schema: str = DOCUMENT_SCHEMA) -> DataFrame:
    """Typed columns of a JSON text column, with ``error`` for unreadable messages."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = df.withColumn("_m", F.from_json(body, schema, options))
    bad = F.col("_m._corrupt_record").isNotNull() | F.col("_m").isNull()
    return parsed.select(
        *df.columns, "_m.*", F.when(bad, PARSE_FAILED).alias("error")
    ).drop("_corrupt_record")


def document_error(df: DataFrame, body: str | None = None) -> Column:
    """Why a parsed message is no document; a missing title is allowed.

    With ``body``, metadata must also be an object and content a string in that JSON text.
    """
    needed = ["doc_id", "source", "content", "metadata"]
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in needed])
    return F.coalesce(
        F.col("error"),
        F.concat(F.lit("missing fields: "), text_or_null(missing)),
        *([] if body is None else _wrong_kinds(F.col(body))),
    )


def _wrong_kinds(body: Column) -> list[Column]:
    whole = F.try_parse_json(body)

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(whole, path, "variant"))

    return [
        F.when(~kind("$.metadata").startswith("OBJECT"), "metadata is not an object"),
        F.when(kind("$.content") != "STRING", "content is not a string"),
    ]


def read_documents(df: DataFrame, body: str) -> DataFrame:
    parsed = parse_messages(df, body)
    return parsed.withColumn("error", document_error(parsed, body))
