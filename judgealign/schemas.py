"""Record schemas and the dimension table of both rubrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

S, I, D, B, L = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.LongType()

# ---- fixed values: dimension names, annotation fields, labels -------------------------------------
# (prediction dimension, annotation field, label)
REALISM_DIMS = [
    ("pitch_dynamics", "pitch_variation", "PitchDynamics"),
    ("rhythmic_naturalness", "rhythmic_naturalness", "RhythmicNaturalness"),
    ("stress_emphasis", "stress_and_emphasis", "StressEmphasis"),
    ("emotion_accuracy", "emotion_accuracy", "EmotionAccuracy"),
    ("emotion_intensity", "emotion_intensity_control", "EmotionIntensity"),
    ("emotional_dynamic_range", "dynamic_range", "EmotionalDynamicRange"),
    ("voice_identity_matching", "voice_identity_matching", "VoiceIdentityMatching"),
    ("trait_embodiment", "trait_embodiment", "TraitEmbodiment"),
    ("local_scene_fit", "local_story_fit", "LocalSceneFit"),
    ("global_story_fit", "global_story_coherence", "GlobalStoryFit"),
]
REALISM_EXTRA = [("semantic_matchness", "semantic_match", "SemanticMatchness")]
ARCHETYPE_DIMS = [
    ("audio_quality", "audio_quality", "AudioQuality"),
    ("human_likeness", "human_likeness", "HumanLikeness"),
    ("appropriateness", "appropriateness", "Appropriateness"),
    ("content_pass", "content_pass", "ContentPass"),
]
# scored fields of the other output forms (all 1..5)
OTHER_FORMS = {
    "audio_quality": ["clarity", "noise_level", "balance", "production_quality", "overall_score"],
    "emotion_analysis": ["emotion_intensity"],
}
GATE_DIM = "content_pass"
CONFIDENCE_FIELD = "annotator_confidence_rating"
OVERALL = "OVERALL"
# ---------------------------------------------------------------------------------------------------


def pred_dims(rubric: str) -> list[str]:
    return [d for d, _, _ in (REALISM_DIMS if rubric == "realism" else ARCHETYPE_DIMS)]


def dim_map_rows() -> list[tuple]:
    rows = []
    for rubric, dims in (("realism", REALISM_DIMS + REALISM_EXTRA), ("archetype", ARCHETYPE_DIMS)):
        for i, (dim, field, label) in enumerate(dims):
            gate = dim == GATE_DIM
            rows.append((rubric, dim, field, label, i, 0 if gate else 1, 1 if gate else 5))
    for form, names in OTHER_FORMS.items():
        rows += [(form, n, n, n, i, 1, 5) for i, n in enumerate(names)]
    return rows


def dim_map(spark: SparkSession) -> DataFrame:
    """One row per rubric dimension: annotation field, label, order and score range (fixed, a few rows)."""
    return spark.createDataFrame(
        dim_map_rows(), "rubric string, dim string, gt_field string, label string, ord int, lo int, hi int"
    )


def _ratings_struct(fields: list[str], element: T.DataType) -> list[T.StructField]:
    return [T.StructField(f, T.ArrayType(element)) for f in fields]


_REALISM_FIELDS = [f for _, f, _ in REALISM_DIMS + REALISM_EXTRA] + [CONFIDENCE_FIELD]

REALISM_ITEM = T.StructType(
    [
        T.StructField(n, S)
        for n in (
            "id", "local_scene", "char_age", "char_style", "char_profile",
            "transcript", "wav_path", "data_source", "dataset_name",
        )
    ]
    + [
        T.StructField("audio_info", T.StructType([T.StructField("audio_caption", S), T.StructField("emotion_caption", S)])),
        T.StructField("annotations", T.StructType(_ratings_struct(_REALISM_FIELDS, S))),
        T.StructField("_corrupt_record", S),
    ]
    # ratings may also sit at the top level of the record
    + _ratings_struct(_REALISM_FIELDS, S)
)

ARCHETYPE_ITEM = T.StructType(
    [T.StructField(n, S) for n in ("id", "question", "wav_path", "dataset_name")]
    + [
        T.StructField(
            "annotations",
            T.StructType(
                _ratings_struct([f for _, f, _ in ARCHETYPE_DIMS] + ["confidence"], S)
                + _ratings_struct([f + "_comment" for _, f, _ in ARCHETYPE_DIMS[:3]], S)
            ),
        ),
        T.StructField("_corrupt_record", S),
    ]
)

JUDGE_RESULT = T.StructType(
    [
        T.StructField("id", S),
        T.StructField("model_name", S),
        T.StructField("response", S),
        T.StructField("audio_path", S),
        T.StructField("prompt", S),
        T.StructField("error", B),
        T.StructField("_corrupt_record", S),
    ]
)


def judge_result_schema(dims: list[str]) -> T.StructType:
    """Judge results whose scores may also be given as top-level keys."""
    fields = [f for f in JUDGE_RESULT.fields if f.name != "_corrupt_record"]
    fields += [T.StructField(d, D) for d in dims]
    return T.StructType(fields + [T.StructField("_corrupt_record", S)])


DIMENSION_RESULT = T.StructType(
    [
        T.StructField(n, S)
        for n in (
            "id", "original_id", "char_profile", "char_style", "transcript", "local_scene",
            "evaluation_type", "specific_dimension", "raw_model_output", "evaluation_text",
        )
    ]
    + [
        T.StructField("model_score", D),
        T.StructField("probability_score", D),
        T.StructField("dimension_scores", T.MapType(S, D)),
        T.StructField("ground_truth_ratings", T.MapType(S, T.ArrayType(S))),
    ]
)

CHECKPOINT = T.StructType(
    [
        T.StructField("args", T.MapType(S, S)),
        T.StructField("results", T.ArrayType(S)),
        T.StructField("processed_indices", T.ArrayType(L)),
        T.StructField("timestamp", D),
        T.StructField("start_time", D),
        T.StructField("total_processed", L),
    ]
)

MCQ_ITEM = T.StructType(
    [
        T.StructField("question_text", S),
        T.StructField("multi_choice", T.ArrayType(S)),
        T.StructField("answer", I),
        T.StructField("audio_path", S),
        T.StructField("dataset_name", S),
    ]
)
