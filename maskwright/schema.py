"""The fixed schemas: spans, reports, audit entries, evaluation tables."""

from pyspark.sql import types as T

SPAN = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("expanded", T.BooleanType()),
    ]
)
SPANS = T.ArrayType(SPAN)
SPAN_DDL = "struct<start:int,end:int,entity_type:string,origin:string,score:double,expanded:boolean>"
SPANS_DDL = f"array<{SPAN_DDL}>"

RECORD_DDL = "text string, entities array<struct<start:int,end:int,entity_type:string>>"
ANNOTATION_DDL = "sentence_id string, start int, end int, label string, note string"
ITEMS_DDL = "sentence_id string, text string, type string, language string, script string"
LOSS_DDL = "model_id string, example_id string, membership string, loss double"
AUDIT_DDL = (
    "log_id string, position long, seq long, transaction_id string, timestamp double, input_hash string, output_hash string, "
    "entity_labels array<struct<entity_type:string,start:int,end:int>>, model_version_hash string, client_cert_fingerprint string, "
    "previous_entry_hash string, entry_hash string, signature string"
)

ENTITY_TYPES = ("EMAIL", "URL", "IP_ADDRESS", "PHONE", "IBAN", "NATIONAL_ID")
SCORED_TYPES = ("PHONE", "IBAN", "EMAIL", "NATIONAL_ID")
