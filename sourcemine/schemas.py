"""Explicit schemas of the tables that the package reads and writes."""

from pyspark.sql import types as T

COUNTS = T.StructType(
    [
        T.StructField("n_operators", T.IntegerType()),
        T.StructField("n_operands", T.IntegerType()),
        T.StructField("u_operators", T.IntegerType()),
        T.StructField("u_operands", T.IntegerType()),
        T.StructField("complexity", T.IntegerType()),
        T.StructField("sloc", T.IntegerType()),
        T.StructField("comment_pct", T.DoubleType()),
    ]
)

# Method texts sit beside the method keys, not inside them: readers that need
# only names and lines then skip the text column of a Parquet file.
UNIT = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("is_last", T.BooleanType()),
        T.StructField("code", T.StringType()),
        T.StructField(
            "methods",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("line", T.IntegerType()),
                    ]
                )
            ),
        ),
        T.StructField("method_code", T.ArrayType(T.StringType())),
        T.StructField("counts", COUNTS),
        T.StructField("counts_error", T.StringType()),
    ]
)

SOURCE_FILES_RAW = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("path", T.StringType(), False),
        T.StructField("content", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)

PARSED_FILES = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("units", T.ArrayType(UNIT)),
    ]
)

TREE_LISTING = T.StructType(
    [
        # Names are bytes on disk and need not be text: ``raw`` opens the file.
        T.StructField("raw", T.BinaryType()),
        T.StructField("path", T.StringType()),
        T.StructField("dir", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("size", T.LongType()),
    ]
)

PROMPT_TEMPLATES = T.StructType(
    [
        T.StructField("prompt_id", T.StringType(), False),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("description", T.StringType()),
        T.StructField("template", T.StringType()),
    ]
)

REFERENCE_DOCS = T.StructType(
    [
        T.StructField("block", T.StringType()),
        T.StructField("doc_key", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("intro", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)

CHOICES = T.ArrayType(
    T.StructType(
        [T.StructField("message", T.StructType([T.StructField("content", T.StringType())]))]
    )
)

COMPLETIONS = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("name", T.StringType(), False),
        T.StructField("prompt_sha", T.StringType()),
        T.StructField("request_sha", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("choices", CHOICES),
        T.StructField("error", T.StringType()),
    ]
)

FAILURES = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("context", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("error_msg", T.StringType()),
    ]
)
