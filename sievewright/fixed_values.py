"""Names, lists and patterns that must be exactly these for right results."""

SPLITS = ["train", "validation", "test"]
SPLIT_PERCENT = {"train": 70, "validation": 15, "test": 15}

# category spellings -> canonical category
GENDER_MAP = {
    "female": "female",
    "Female": "female",
    "female_feminine": "female",
    "male": "male",
    "Male": "male",
    "male_masculine": "male",
}
UNKNOWN_WORDS = ["nan", "none", "unknown"]

# generator spellings -> canonical generator
GENERATOR_ALIASES = {
    "xttsv2": "xtts_v2",
    "xtts_v2": "xtts_v2",
    "vits": "vits",
    "freevc": "freevc24",
    "freevc_24": "freevc24",
    "freevc24": "freevc24",
}

LABEL_MAP = {"bonafide": "real", "spoof": "fake"}

# substring of the codec name -> bit depth, first match wins
BIT_DEPTHS = [
    ("PCM_16", "16-bit PCM"),
    ("PCM_24", "24-bit PCM"),
    ("PCM_32", "32-bit"),
    ("FLOAT", "32-bit"),
    ("MPEG_LAYER_III", "lossy (MP3)"),
    ("OPUS", "lossy (Opus/Vorbis)"),
    ("VORBIS", "lossy (Opus/Vorbis)"),
]
BIT_DEPTH_OTHER = "other"

DURATION_EDGES = [0, 1, 2, 3, 5, 8, 12, 20, 1e9]
DURATION_LABELS = ["<1s", "1-2s", "2-3s", "3-5s", "5-8s", "8-12s", "12-20s", ">20s"]

STRONG_ACCURACY = 0.75

SEED = 42

TRAIN_CONDITIONS = [
    "mp3_32", "mp3_64", "mp3_128", "opus_12", "opus_24", "opus_48",
    "telephone", "lowpass", "gain", "mild_clipping", "multi_codec",
]
LOWPASS_CUTOFFS = [4000, 5000, 6000, 7000]
GAIN_DB = [-9, -6, -3, 3]
MULTI_CODEC_CHAINS = ["mp3_64__opus_24", "opus_24__mp3_64"]
CLIPPING_BOOST_DB = 6
TELEPHONE_BAND = "300-3400"
TELEPHONE_RATE = 8000

# condition, parameters as JSON with sorted keys
ROBUSTNESS_CONDITIONS = [
    ("mp3", '{"bitrate_kbps":64,"codec":"mp3"}'),
    ("opus", '{"bitrate_kbps":24,"codec":"opus"}'),
    ("telephone", '{"band_hz":"300-3400","intermediate_rate":8000}'),
    ("lowpass", '{"cutoff_hz":4000}'),
    ("multi_codec", '{"chain":"mp3_64__opus_24"}'),
]

FORBIDDEN_COLUMNS = [
    "transcript", "tnorm",
    "speaker_id", "target_speaker_id", "source_speaker_id",
    "source_file_id", "session_id", "utterance_id", "row_id",
    "gender", "gender_normalized",
    "voice",
    "source_reference_audio", "target_reference_audio",
    "file_path",
]
USER_PATH_PATTERN = r"[A-Za-z]:[\\/]{1,2}Users[\\/]"

MASTER_COLUMNS = [
    "sample_id", "file_path",
    "language", "language_type", "label",
    "source_dataset", "generator", "voice",
    "speaker_id", "target_speaker_id", "source_speaker_id",
    "session_id", "source_file_id", "gender",
    "split",
    "duration", "original_sample_rate", "codec", "channels",
    "file_bytes", "sha256",
    "transcript",
    "license", "license_status",
    "declared_duration", "declared_sample_rate", "declared_codec",
    "exists", "probe_error", "origin_metadata_file",
]

UNKNOWN_LICENSE = ("unknown", "UNVERIFIED")

DURATION_TOLERANCE = 0.05
INITIAL_ENTITY_CAP = 30
ENTITY_CAP_LIMIT = 400
DIVERSITY_GRADES = [(100, "EXCELLENT"), (75, "PREFERRED")]
DIVERSITY_BELOW = "BELOW TARGET"
PCM16_LOW, PCM16_HIGH = -32768, 32767
SILENCE_FLOOR_DB = -240.0

FAMILY_OF_GENERATOR = {"freevc24": "voice_conversion"}
FAMILY_OTHER = "text_to_speech"
