"""Declared schemas and label vocabularies.

Three label vocabularies exist; their integer codes differ, so everything is
keyed by the label string and codes are attached through these tables only.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# They must equal the reference's for results to agree.
# 5-class vocabulary (main), in code order 0..4.
CATEGORIES = ["Support_Text", "Support_Multimodal", "Insufficient_Text",
              "Insufficient_Multimodal", "Refute"]
# 5-class vocabulary of the ensemble baseline, in its own code order 0..4.
ENSEMBLE_CATEGORIES = ["Support_Multimodal", "Support_Text", "Insufficient_Multimodal",
                       "Insufficient_Text", "Refute"]
# 3-class vocabulary, code order 0..2, and its spellings.
SIMPLE_CLASSES = ["Support", "NEI", "Refute"]
VERDICTS = ["support", "not_enough_information", "refute"]
VOTE_LABELS = ["supported", "refuted", "NEI"]
# Category -> path labels (text_text, text_image, image_text, image_image);
# 0 Support, 1 NEI, 2 Refute. Unknown category -> 1,1,1,1.
CATEGORY_PATH_LABELS = {
    "Support_Text": (0, 1, 1, 1),
    "Support_Multimodal": (0, 0, 0, 0),
    "Insufficient_Text": (1, 1, 1, 1),
    "Insufficient_Multimodal": (1, 1, 1, 0),
    "Refute": (2, 2, 2, 2),
}
UNKNOWN_PATH_LABELS = (1, 1, 1, 1)
UNKNOWN_LABELS_CATEGORY = "Insufficient_Text"
# 5-class -> 3-class.
SIMPLIFIED = {
    "Support_Text": "Support",
    "Support_Multimodal": "Support",
    "Insufficient_Text": "NEI",
    "Insufficient_Multimodal": "NEI",
    "Refute": "Refute",
}
PATHS = ["text_text", "text_image", "image_text", "image_image"]
REFUTE_WEIGHT = 4.0
RETRIEVAL_KS = [1, 2, 5, 10]
ENSEMBLE_WEIGHTS = [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]
ENSEMBLE_POWERS = [1 / 8, 1 / 4, 1 / 2, 1, 2]
ENSEMBLE_SETTING = {"w": (0.2, 0.7, 0.6), "p": (0.125, 0.125, 0.25)}
ANSWER_MARKER = "### Answer:"
# ---------------------------------------------------------------------------

RAW_CLAIM_COLUMNS = ["id", "claim", "claim_image", "evidence", "evidence_image",
                     "category", "claim_ocr", "evidence_ocr"]

RAW_CLAIMS = T.StructType(
    [T.StructField("id", T.LongType(), False)]
    + [T.StructField(c, T.StringType(), True) for c in RAW_CLAIM_COLUMNS[1:]]
)

TEXT_CORPUS = T.StructType([
    T.StructField("split", T.StringType(), False),
    T.StructField("id", T.LongType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType()), False),
])

IMAGE_CORPUS = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType()), False),
])

QRELS = T.StructType([
    T.StructField("TOPIC", T.LongType(), False),
    T.StructField("DOCUMENT#", T.StringType(), False),
    T.StructField("RELEVANCY", T.IntegerType(), True),
    T.StructField("evidence_relevant", T.IntegerType(), True),
])

CANDIDATES = T.StructType([
    T.StructField("query_id", T.LongType(), False),
    T.StructField("corpus_id", T.StringType(), False),
    T.StructField("score", T.DoubleType(), True),
])

FETCH_STATUS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("category", T.StringType(), True),
    T.StructField("role", T.StringType(), False),
    T.StructField("ok", T.BooleanType(), False),
])

METRIC_ROW = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("metric", T.StringType(), False),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("run_ts", T.TimestampType(), True),
])
