"""Defaults and fixed values shared by all operators."""

from __future__ import annotations

# Ids and roles of the marks, as every encoded sequence carries them.
PAD, BOS, EOS, UNK, MASK = 0, 1, 2, 3, 4
MARKS = ["<pad>", "<s>", "</s>", "<unk>", "<mask>"]
ROLES = {
    "bos_token": "<s>",
    "cls_token": "<s>",
    "eos_token": "</s>",
    "mask_token": "<mask>",
    "pad_token": "<pad>",
    "sep_token": "</s>",
    "unk_token": "<unk>",
}
SENTINELS_START, SENTINELS = 32000, 100  # <extra_id_99> .. <extra_id_0>

# Corpus and split.
INPUT_COLUMN, OUTPUT_COLUMN = "title", "code"
TEST_FRACTION = 0.2
SEED = 2050

# Vocabulary and sequence sizes.
VOCABULARY_SIZE = 52000
CHUNK_ROWS = 1000
SEQUENCE_LENGTH = 512
PROMPT_LENGTH = 100
PROMPT_CHARACTERS = 512
TRAIN_BATCH, VALIDATION_BATCH = 32, 8

# Fitting.
EPOCHS = 2
PATIENCE = 5
MODEL_WIDTH = 212
WARMUP_STEPS = 4000
FIXED_RATE = 2.5e-5
POSITIONS = 562
TIER_GOOD, TIER_FAIR = 0.2, 0.5
TEMPERATURE = 0.7

# No fixed values: how many tokens and merges the queries ask for. The operators take any number.
ANSWER_LENGTH, COMPARED_LENGTH = 20, 8
MERGES = 60

# Largest vocabulary an operator will broadcast: learned entries plus all reserved ones.
VOCABULARY_BOUND = VOCABULARY_SIZE + len(MARKS) + SENTINELS

WORD_PATTERN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
