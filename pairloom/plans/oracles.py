"""DuckDB SQL with the same results as ``queries``, written from the definitions and over the whole tables."""

from __future__ import annotations

import re

from pairloom.functions.text import BLANK
from pairloom.settings import (
    ANSWER_LENGTH,
    COMPARED_LENGTH,
    EPOCHS,
    FIXED_RATE,
    MARKS,
    MERGES,
    MODEL_WIDTH,
    PATIENCE,
    PROMPT_CHARACTERS,
    PROMPT_LENGTH,
    ROLES,
    SEED,
    SENTINELS,
    SENTINELS_START,
    SEQUENCE_LENGTH,
    TEMPERATURE,
    TRAIN_BATCH,
    VALIDATION_BATCH,
    VOCABULARY_SIZE,
    WARMUP_STEPS,
    WORD_PATTERN,
)

ORACLES: dict[str, str] = {}
L = SEQUENCE_LENGTH


def sql(name: str, select: str, *parts: str) -> None:
    ORACLES[name] = (f"WITH {', '.join(parts)} " if parts else "") + select


DOCUMENTS = """pairs AS (
    SELECT doc_id AS pair_id, substr(text, 1, instr(text, chr(10)) - 1) AS title,
           substr(text, instr(text, chr(10)) + 1) AS code
    FROM documents WHERE instr(text, chr(10)) > 0)"""
TURNS = """pairs AS (
    SELECT conv_id * 1000 + turn AS pair_id, text AS title, next_text AS code
    FROM (SELECT *, lead(turn) OVER w AS next_turn, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
          FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    WHERE role = 'user' AND next_role = 'assistant' AND next_turn = turn + 1)"""
SPLIT = f"""split AS (
    SELECT *, CASE WHEN ('0x' || substr(md5('{SEED}|' || pair_id), 1, 8))::BIGINT % 1000 < 200
                   THEN 'test' ELSE 'train' END AS split FROM pairs)"""
VOCAB = f"""words AS (
    SELECT token, count(*) AS n FROM (
        SELECT unnest(regexp_extract_all(lower(code), '{WORD_PATTERN}')) AS token FROM split WHERE split = 'train')
    GROUP BY token),
ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, token) AS r FROM words),
vocab AS (SELECT token, CASE WHEN r + 4 < {SENTINELS_START} THEN r + 4 ELSE r + 4 + {SENTINELS} END AS id, n
          FROM ranked WHERE r <= {VOCABULARY_SIZE})"""


def ids(limit: int = L) -> str:
    """``ids(pair_id, split, title, code)``: cut lists of ids without marks."""
    return f"""tokens AS (
    SELECT pair_id, side, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (
        SELECT pair_id, side, regexp_extract_all(lower(txt), '{WORD_PATTERN}')[1:{limit - 2}] AS t
        FROM (SELECT pair_id, 'title' AS side, title AS txt FROM split UNION ALL
              SELECT pair_id, 'code', code FROM split))),
found AS (SELECT pair_id, side, list(coalesce(id, 3) ORDER BY pos) AS l
          FROM tokens LEFT JOIN vocab USING (token) GROUP BY pair_id, side),
ids AS (SELECT s.pair_id, s.split, coalesce(a.l, []::BIGINT[]) AS title, coalesce(b.l, []::BIGINT[]) AS code
        FROM split s LEFT JOIN found a ON a.pair_id = s.pair_id AND a.side = 'title'
        LEFT JOIN found b ON b.pair_id = s.pair_id AND b.side = 'code')"""


def framed(column: str, limit: int = L) -> str:
    return f"list_resize([1::BIGINT] || {column} || [2::BIGINT], {limit}, 0)"


ENCODED = f"""framed AS (SELECT pair_id, split, {framed('title')} AS input_ids, {framed('code')} AS target FROM ids),
encoded AS (SELECT pair_id, split, input_ids, target[1:{L - 1}] AS targ_in, target[2:{L}] AS targ_out FROM framed)"""

DOC_SPLIT = (DOCUMENTS, SPLIT)
DOC_VOCAB = (*DOC_SPLIT, VOCAB)
DOC_IDS = (*DOC_VOCAB, ids())
DOC_ENCODED = (*DOC_IDS, ENCODED)
TURN_ENCODED = (TURNS, SPLIT, VOCAB, ids(), ENCODED)


def shown(column: str, alias: str | None = None) -> str:
    return f"array_to_string({column}, ' ') AS {alias or column}"


# --- sources, sinks, stages -------------------------------------------------------------------------------------

sql("pairs_scan", "SELECT * FROM conversations")
sql("pairs_select", "SELECT doc_id AS pair_id, lang AS title, text AS code FROM documents")
sql("pairs_from_turns", "SELECT * FROM pairs", TURNS)
sql("pairs_from_documents", "SELECT * FROM pairs", DOCUMENTS)
sql("drop_columns", "SELECT doc_id, text, lang FROM documents")
sql("named_splits", "SELECT *, 'train' AS split FROM pairs", DOCUMENTS)
sql("cleaned_write", "SELECT pair_id, split, title, code FROM split", *DOC_SPLIT)
sql("cleaned_load_test", "SELECT pair_id, title FROM split WHERE split = 'test'", *DOC_SPLIT)
sql("stage_reuse", "SELECT split, count(*) AS rows, 2::BIGINT AS builds FROM split GROUP BY split", *DOC_SPLIT)


def history(run: str) -> str:
    even, odd = "user_id % 2 = 0", "user_id % 2 <> 0"
    above = "(value > 50)::INT"

    def mean(rows: str) -> str:
        """Rounded half up in whole millionths."""
        total, n = f"sum(round(value * 1000000)::HUGEINT) FILTER ({rows})", f"count(*) FILTER ({rows})"
        return f"((2 * {total} + {n}) // nullif(2 * {n}, 0))::DOUBLE / 1000000"

    return f"""SELECT {run} AS run_id, day(ts) AS epoch,
        {mean(even)} AS loss, {mean(odd)} AS val_loss,
        round(avg({above}) FILTER ({even}), 6) AS masked_accuracy,
        round(avg({above}) FILTER ({odd}), 6) AS val_masked_accuracy FROM events GROUP BY ALL"""


HISTORY = f"history AS ({history('event_type')})"
ORACLES["history_roundtrip"] = f"{history('event_type')} UNION ALL {history(chr(39) + 'all' + chr(39))}"
sql("vocab_roundtrip", "SELECT token, id, n FROM vocab", *DOC_VOCAB)

# --- splits and steps -------------------------------------------------------------------------------------------

STEPS = f"""count(*) // {TRAIN_BATCH}"""


def steps(train: str) -> str:
    test = "count(*) FILTER (split = 'test')"
    return f"""SELECT {train} AS train_rows, {test} AS test_rows, {train} // {TRAIN_BATCH} AS train_steps,
        ceil({test} / {VALIDATION_BATCH})::BIGINT AS validation_steps FROM split"""


TRAIN_ROWS = "count(*) FILTER (split = 'train')"
EXACT = f"row_number() OVER (ORDER BY md5('{SEED}|' || pair_id), pair_id) <= ceil(0.2::DOUBLE * count(*) OVER ())"
TAIL = "row_number() OVER (ORDER BY pair_id) > count(*) OVER () - ceil(0.2::DOUBLE * count(*) OVER ())"

sql("split_counts", "SELECT split, count(*) AS rows FROM split GROUP BY split", *DOC_SPLIT)
sql("split_fraction", "SELECT pair_id, split FROM split", *DOC_SPLIT)
sql("split_exact", f"SELECT pair_id, CASE WHEN {EXACT} THEN 'test' ELSE 'train' END AS split FROM pairs", DOCUMENTS)
sql("split_tail", f"SELECT pair_id, CASE WHEN {TAIL} THEN 'test' ELSE 'train' END AS split FROM pairs", DOCUMENTS)
sql("split_disabled", steps(TRAIN_ROWS), DOCUMENTS, "split AS (SELECT *, 'train' AS split FROM pairs)")
sql("steps_per_epoch", steps(TRAIN_ROWS), *DOC_SPLIT)
sql("steps_before_split", steps("count(*)"), *DOC_SPLIT)

# --- vocabulary, encoding, decoding -----------------------------------------------------------------------------

TRAIN = "train AS (SELECT pair_id FROM split WHERE split = 'train')"
TEST = "test AS (SELECT pair_id FROM split WHERE split = 'test')"
mark_rows = ", ".join(
    f"({i}, '{m}', '{','.join(r for r in sorted(ROLES) if ROLES[r] == m)}')" for i, m in enumerate(MARKS)
)
RESERVED = f"""reserved AS (
    SELECT * FROM (VALUES {mark_rows}) v(id, token, roles) UNION ALL
    SELECT {SENTINELS_START} + i, '<extra_id_' || ({SENTINELS - 1} - i) || '>', '' FROM range({SENTINELS}) r(i))"""

sql("corpus_chunks", "SELECT pair_id, (row_number() OVER (ORDER BY pair_id) - 1) // 1000 AS chunk_id FROM train",
    *DOC_SPLIT, TRAIN)
sql("vocab_words", "SELECT token, id, n FROM vocab", *DOC_VOCAB)
sql("vocab_size", f"SELECT count(*) + {len(MARKS) + SENTINELS} AS size FROM vocab", *DOC_VOCAB)
sql(
    "special_tokens",
    """SELECT r.id::BIGINT AS id, token, (r.id >= 4)::BIGINT AS lstrip, 1::BIGINT AS normalized, 0::BIGINT AS rstrip,
        0::BIGINT AS single_word, 1::BIGINT AS special, roles, coalesce(uses, 0) AS uses
    FROM reserved r LEFT JOIN used u ON u.id = r.id""",
    *DOC_ENCODED,
    RESERVED,
    "used AS (SELECT id, count(*) AS uses FROM (SELECT unnest(input_ids || targ_in) AS id FROM encoded) GROUP BY id)",
)
sql("encode_ids", f"SELECT pair_id, {shown('title')}, {shown('code')} FROM ids", *DOC_IDS)


def both(made) -> str:
    return f"SELECT pair_id, {', '.join(shown(made(c), c) for c in ('title', 'code'))} FROM ids"


sql("add_bos_eos", both(lambda c: f"[1] || {c} || [2]"), *DOC_IDS)
sql("truncate_ids",
    f"""SELECT pair_id, len(title) AS title_kept, len(code) AS code_kept, {shown('title')}, {shown('code')},
        {shown(f'code[1:{PROMPT_LENGTH - 2}]', 'short')} FROM ids""", *DOC_IDS)
sql("pad_ids", both(framed), *DOC_IDS)
sql("pad_mask", both(lambda c: f"[(x <> 0)::INT FOR x IN {framed(c)}]"), *DOC_IDS)
sql("teacher_forcing", f"SELECT pair_id, split, {shown('input_ids')}, {shown('targ_in')}, {shown('targ_out')} FROM encoded",
    *DOC_ENCODED)
sql("features", f"SELECT pair_id, {shown('input_ids')}, {shown('targ_in')}, {shown('targ_out')} FROM encoded", *DOC_ENCODED)
sql("cast_format", both(lambda c: framed(c, PROMPT_LENGTH)), *DOC_VOCAB, ids(PROMPT_LENGTH))

# A word is its symbols, each between bars; a merge takes out the bars between two. The chain below learns one merge per
# step from the words of the training rows and applies it to all words.
PIECES = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
SUBWORDS = f"""pieces AS (
    SELECT pair_id, split, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (
        SELECT pair_id, split, regexp_extract_all(code, '{PIECES}') AS w FROM split)),
spelt AS (
    SELECT word, count(*) FILTER (split = 'train') AS n,
           regexp_replace(lower(hex(encode(word))), '(..)', '|\\1|', 'g') AS symbols FROM pieces GROUP BY word),
steps AS (
    SELECT 0 AS place, word, n, symbols, NULL::VARCHAR AS l, NULL::VARCHAR AS r, NULL::HUGEINT AS most FROM spelt
    UNION ALL
    SELECT place + 1, word, n, replace(symbols, '|' || best.l || '||' || best.r || '|', '|' || best.l || best.r || '|'),
           best.l, best.r, best.most
    FROM steps, (
        SELECT l, r, sum(n) AS most FROM (
            SELECT n, unnest(s[:-2]) AS l, unnest(s[2:]) AS r
            FROM (SELECT n, string_split(trim(symbols, '|'), '||') AS s FROM steps WHERE n > 0) WHERE len(s) > 1)
        GROUP BY l, r ORDER BY most DESC, l, r LIMIT 1) best
    WHERE place < {MERGES}),
merges AS (SELECT DISTINCT place - 1 AS place, l, r, most FROM steps WHERE place > 0),
symbol_ids AS (
    SELECT token, CASE WHEN min(place) + 5 < {SENTINELS_START} THEN min(place) + 5 ELSE min(place) + 5 + {SENTINELS} END AS id
    FROM (SELECT lower(lpad(to_hex(i), 2, '0')) AS token, i AS place FROM range(256) t(i)
          UNION ALL SELECT l || r, place + 256 FROM merges) GROUP BY token),
last_step AS (SELECT word, string_split(trim(symbols, '|'), '||') AS s FROM steps WHERE place = (SELECT max(place) FROM steps)),
word_ids AS (SELECT word, list(id ORDER BY spot) AS ids FROM (
    SELECT word, unnest(s) AS token, unnest(range(len(s))) AS spot FROM last_step) JOIN symbol_ids USING (token) GROUP BY word),
subwords AS (SELECT pair_id, flatten(list(ids ORDER BY pos)) AS l FROM pieces JOIN word_ids USING (word) GROUP BY pair_id)"""
TURN_SUBWORDS = (TURNS, SPLIT, SUBWORDS)


def recursive(name: str, select: str, *parts: str) -> None:
    ORACLES[name] = f"WITH RECURSIVE {', '.join(parts)} {select}"


recursive("bpe_merges", 'SELECT place::BIGINT AS place, l AS "left", r AS "right", most::BIGINT AS n FROM merges', *TURN_SUBWORDS)
recursive("encode_bpe",
    f"""SELECT pair_id, {shown(framed(f'l[1:{L - 2}]'), 'ids')}
    FROM (SELECT pair_id, coalesce(l, []::BIGINT[]) AS l FROM split LEFT JOIN subwords USING (pair_id))""", *TURN_SUBWORDS)
recursive("decode_bpe",
    "SELECT pair_id, code AS text, coalesce(len(l), 0) AS pieces FROM split LEFT JOIN subwords USING (pair_id)", *TURN_SUBWORDS)
sql(
    "decode_text",
    """SELECT e.pair_id, coalesce(string_agg(v.token, ' ' ORDER BY pos), '') AS text
    FROM (SELECT pair_id, unnest(targ_out) AS id, unnest(range(len(targ_out))) AS pos FROM encoded) e
    LEFT JOIN vocab v ON v.id = e.id GROUP BY e.pair_id""",
    *DOC_ENCODED,
)

# --- epochs and batches -----------------------------------------------------------------------------------------

SHUFFLED = f"""shuffled AS (
    SELECT epoch, pair_id, count(*) OVER (PARTITION BY epoch) AS total,
           row_number() OVER (PARTITION BY epoch ORDER BY md5('{SEED}|' || epoch || '|' || pair_id), pair_id) - 1 AS rank
    FROM train, range({EPOCHS}) r(epoch))"""
LAYOUT = f"""layout AS (SELECT epoch, (epoch * total + rank) // {TRAIN_BATCH} AS batch_id,
    (epoch * total + rank) % {TRAIN_BATCH} AS slot, pair_id, total FROM shuffled)"""
LIMITED = f"""limited AS (SELECT epoch, batch_id, slot, pair_id, batch_id // (total // {TRAIN_BATCH}) AS fit_epoch
    FROM layout WHERE batch_id < {EPOCHS} * (total // {TRAIN_BATCH}))"""
DOC_TRAIN = (*DOC_SPLIT, TRAIN, SHUFFLED)
DOC_LIMITED = (*DOC_TRAIN, LAYOUT, LIMITED)

sql("epoch_shuffle", "SELECT epoch, pair_id, rank FROM shuffled", *DOC_TRAIN)
sql("epoch_repeat", "SELECT epoch, pair_id FROM shuffled", *DOC_TRAIN)
sql("train_batches", "SELECT epoch, batch_id, slot, pair_id FROM layout", *DOC_TRAIN, LAYOUT)
sql(
    "train_batches_per_epoch",
    f"""SELECT epoch, epoch * ceil(total / {TRAIN_BATCH})::BIGINT + rank // {TRAIN_BATCH} AS batch_id,
        rank % {TRAIN_BATCH} AS slot, pair_id FROM shuffled""",
    *DOC_TRAIN,
)
sql(
    "val_batches",
    f"""SELECT epoch, g // {VALIDATION_BATCH} AS batch_id, g % {VALIDATION_BATCH} AS slot, pair_id FROM (
        SELECT epoch, pair_id, epoch * total + rank AS g, total FROM (
            SELECT pair_id, row_number() OVER (ORDER BY pair_id) - 1 AS rank, count(*) OVER () AS total FROM test),
            range({VALIDATION_BATCH}) r(epoch))
    WHERE g < ceil(total / {VALIDATION_BATCH}) * {VALIDATION_BATCH}""",
    *DOC_SPLIT,
    TEST,
)
sql("steps_limit", "SELECT * FROM limited", *DOC_LIMITED)
sql("batch_export",
    f"SELECT batch_id, slot, l.pair_id, {shown('input_ids')}, {shown('targ_out')} FROM limited l JOIN encoded USING (pair_id)",
    *DOC_ENCODED, TRAIN, SHUFFLED, LAYOUT, LIMITED)

# --- metrics, schedule, history ---------------------------------------------------------------------------------

SCORED = f"""logits AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS z FROM embeddings),
scored AS (SELECT vec_id, label, list_position(z, list_max(z)) - 1 AS predicted, vec_id // {TRAIN_BATCH} AS batch_id,
    ln(list_sum([exp(x) FOR x IN z])) - z[label + 1] AS loss FROM logits)"""
LOSS = "round(sum(loss) FILTER (label <> 0) / nullif(count(*) FILTER (label <> 0), 0), 6) AS loss"
COUNTED = "nullif(count(*) FILTER (label <> 0), 0)"
ACCURACY = f"round(count(*) FILTER (predicted = label) / {COUNTED}, 6) AS accuracy"
STRICT = f"round(count(*) FILTER (predicted = label AND label <> 0) / {COUNTED}, 6) AS accuracy_strict"


def rate(step: str) -> str:
    """The schedule; step 0 gives 0."""
    down = f"CASE WHEN {step} = 0 THEN 'infinity'::DOUBLE ELSE pow({step}, -0.5) END"
    return f"round(pow({MODEL_WIDTH}, -0.5) * least({down}, {step} * pow({WARMUP_STEPS}, -1.5)), 6)"


sql("argmax_class", "SELECT vec_id, predicted::BIGINT AS predicted FROM scored", SCORED)
sql("masked_loss", f"SELECT {LOSS} FROM scored", SCORED)
sql("masked_loss_by_batch", f"SELECT batch_id, {LOSS} FROM scored GROUP BY batch_id", SCORED)
sql("masked_accuracy", f"SELECT {ACCURACY} FROM scored", SCORED)
sql("masked_accuracy_strict", f"SELECT {STRICT} FROM scored", SCORED)
sql("lr_schedule", f"SELECT event_id, {rate('event_id')} AS learning_rate FROM events")
sql("lr_fixed", f"SELECT DISTINCT batch_id, batch_id + 1 AS step, round({FIXED_RATE}::DOUBLE, 6) AS learning_rate FROM limited",
    *DOC_LIMITED)
sql("lr_by_batch", f"SELECT DISTINCT batch_id, batch_id + 1 AS step, {rate('(batch_id + 1)')} AS learning_rate FROM limited",
    *DOC_LIMITED)

STOPS = f"""improving AS (
    SELECT *, val_loss IS NOT NULL AND coalesce(val_loss < min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM history),
waiting AS (
    SELECT *, epoch - max(epoch) FILTER (improved) OVER (PARTITION BY run_id ORDER BY epoch) AS waited FROM improving),
stops AS (SELECT run_id, min(epoch) FILTER (waited >= {PATIENCE}) AS stopped_epoch FROM waiting GROUP BY run_id),
ran AS (SELECT i.*, stopped_epoch FROM improving i JOIN stops USING (run_id)
        WHERE stopped_epoch IS NULL OR epoch <= stopped_epoch)"""

sql("best_epochs", "SELECT run_id, epoch, val_loss FROM ran WHERE improved", HISTORY, STOPS)
sql("early_stop",
    "SELECT run_id, max(epoch) FILTER (improved) AS best_epoch, any_value(stopped_epoch) AS stopped_epoch FROM ran GROUP BY run_id",
    HISTORY, STOPS)
sql("loss_series",
    """SELECT run_id, epoch, 'Training Loss' AS series, loss AS value FROM ran UNION ALL
    SELECT run_id, epoch, 'Validation Loss', val_loss FROM ran""", HISTORY, STOPS)
sql("performance_tier",
    """SELECT run_id, val_loss, CASE WHEN val_loss < 0.2 THEN 'excellent' WHEN val_loss < 0.5 THEN 'good'
        ELSE 'needs training' END AS tier
    FROM (SELECT run_id || '/' || scale AS run_id, round(arg_max_null(val_loss, epoch) / scale, 6) AS val_loss
        FROM ran, (VALUES (50), (150), (400)) v(scale) GROUP BY run_id, scale)""", HISTORY, STOPS)
sql("run_summary",
    f"""SELECT run_id, last_epoch, stopped_epoch, val_loss, val_masked_accuracy, {rate('(last_epoch * steps)')} AS final_rate
    FROM (SELECT run_id, max(epoch) AS last_epoch, any_value(stopped_epoch) AS stopped_epoch,
            arg_max_null(val_loss, epoch) AS val_loss, arg_max_null(val_masked_accuracy, epoch) AS val_masked_accuracy
        FROM ran GROUP BY run_id), (SELECT count(*) // {TRAIN_BATCH} AS steps FROM split WHERE split = 'train')""",
    HISTORY, STOPS, *DOC_SPLIT)

# --- learning, scoring, decoding --------------------------------------------------------------------------------

POSITIONS = f"""positions AS (
    SELECT * FROM (SELECT pair_id, split, unnest(targ_out) AS w, unnest(targ_in) AS c1,
        unnest([0] || targ_in[1:{L - 2}]) AS c2, unnest(range({L - 1})) AS pos FROM encoded) WHERE w <> 0)"""
COUNTS = """three AS (SELECT c2, c1, w, count(*) AS n FROM positions WHERE split = 'train' AND c2 <> 0 GROUP BY ALL),
two AS (SELECT c1, w, count(*) AS n FROM positions WHERE split = 'train' GROUP BY ALL),
one AS (SELECT w, count(*) AS n FROM positions WHERE split = 'train' GROUP BY ALL)"""
SMOOTHED = f"""{RESERVED}, entries AS (SELECT id FROM vocab UNION ALL SELECT id FROM reserved),
p_one AS (SELECT id AS w, (coalesce(n, 0) + 1.0::DOUBLE / count(*) OVER ()) / (sum(n) OVER () + 1.0::DOUBLE) AS p
    FROM entries LEFT JOIN one ON one.w = id),
p_two AS (SELECT c1, w, (n + p) / (total + 1) AS p, 1 / (total + 1) AS k
    FROM (SELECT *, sum(n) OVER (PARTITION BY c1)::DOUBLE AS total FROM two) JOIN p_one USING (w)),
p_three AS (SELECT c2, c1, w, (n + p_two.p) / (total + 1) AS p, 1 / (total + 1) AS k
    FROM (SELECT *, sum(n) OVER (PARTITION BY c2, c1)::DOUBLE AS total FROM three) JOIN p_two USING (c1, w)),
left_two AS (SELECT DISTINCT c1, k FROM p_two), left_three AS (SELECT DISTINCT c2, c1, k FROM p_three)"""
TURN_COUNTS = (*TURN_ENCODED, POSITIONS, COUNTS)
TURN_SMOOTHED = (*TURN_COUNTS, SMOOTHED)

PAIRED = """sources AS (SELECT pair_id, split, s, count(*)::DOUBLE AS ns
    FROM (SELECT pair_id, split, unnest(input_ids) AS s FROM encoded) WHERE s <> 0 GROUP BY ALL),
targets AS (SELECT pair_id, w, count(*)::DOUBLE AS nw
    FROM (SELECT pair_id, unnest(targ_out) AS w FROM encoded) WHERE w <> 0 GROUP BY ALL),
lengths AS (SELECT pair_id, sum(ns) AS length FROM sources GROUP BY pair_id),
paired AS (SELECT * FROM sources JOIN targets USING (pair_id)),
seen_pairs AS (SELECT * FROM paired WHERE split = 'train')"""


def em(after: int) -> str:
    """Models ``t1 .. t<after>``."""
    parts = []
    for i in range(1, after + 1):
        source = "seen_pairs" if i == 1 else f"seen_pairs JOIN t{i - 1} USING (s, w)"
        share = "ns" if i == 1 else "ns * t"
        parts.append(
            f"""e{i} AS (SELECT s, w, sum(nw * weight) AS e FROM (
                SELECT s, w, nw, {share} / sum({share}) OVER (PARTITION BY pair_id, w) AS weight FROM {source}) GROUP BY s, w),
            t{i} AS (SELECT s, w, e / sum(e) OVER (PARTITION BY s) AS t FROM e{i})"""
        )
    return ", ".join(parts)


sql("ngram_counts",
    """SELECT 3::BIGINT AS n_order, c2, c1, w, n FROM three UNION ALL
    SELECT 2, NULL, c1, w, n FROM two UNION ALL SELECT 1, NULL, NULL, w, n FROM one""", *TURN_COUNTS)
sql("ngram_model",
    """SELECT 3::BIGINT AS n_order, c2, c1, w, round(p, 6) AS p FROM p_three UNION ALL
    SELECT 2, NULL, c1, w, round(p, 6) FROM p_two UNION ALL SELECT 1, NULL, NULL, w, round(p, 6) FROM p_one""",
    *TURN_SMOOTHED)
sql("align_em", f"SELECT s, w, round(t, 6) AS t FROM t{EPOCHS}", *TURN_ENCODED, PAIRED, em(EPOCHS))
sql("align_weights",
    """SELECT pair_id, s, w, round(ns * t / sum(ns * t) OVER (PARTITION BY pair_id, w), 6) AS weight
    FROM seen_pairs JOIN t1 USING (s, w)""", *TURN_ENCODED, PAIRED, em(1))


def scored(pass_: int) -> str:
    """``a<pass>``: average alignment of each token with the source of each test pair."""
    return f"""a{pass_} AS (SELECT pair_id, w, sum(ns / length * t) AS a FROM sources JOIN lengths USING (pair_id)
        JOIN t{pass_} USING (s) WHERE split = 'test' GROUP BY pair_id, w)"""


MIXED = """0.5 * coalesce(p_three.p, coalesce(left_three.k, 1) * coalesce(p_two.p, coalesce(left_two.k, 1) * p_one.p))
    + 0.5 * coalesce({a}.a, 0)"""
LOOKUPS = """LEFT JOIN left_three ON left_three.c2 = s.c2 AND left_three.c1 = s.c1
    LEFT JOIN left_two ON left_two.c1 = s.c1
    LEFT JOIN p_three ON p_three.c2 = s.c2 AND p_three.c1 = s.c1 AND p_three.w = p_one.w
    LEFT JOIN p_two ON p_two.c1 = s.c1 AND p_two.w = p_one.w
    LEFT JOIN {a} ON {a}.pair_id = s.pair_id AND {a}.w = p_one.w"""

sql("next_token_dist",
    """SELECT pair_id, w, round(p, 6) AS p FROM listed UNION ALL
    SELECT pair_id, -1, round(1 - sum(p), 6) FROM listed GROUP BY pair_id""",
    *TURN_SMOOTHED, PAIRED, em(EPOCHS), scored(EPOCHS),
    "s AS (SELECT pair_id, c2, c1 FROM positions WHERE split = 'test' AND pos = 0)",
    f"""listed AS (SELECT s.pair_id, p_one.w, {MIXED.format(a=f'a{EPOCHS}')} AS p
        FROM s CROSS JOIN p_one {LOOKUPS.format(a=f'a{EPOCHS}')}
        WHERE p_two.p IS NOT NULL OR a{EPOCHS}.a IS NOT NULL)""")


def validation(pass_: int) -> str:
    a = f"a{pass_}"
    return f"""SELECT {pass_}::BIGINT AS epoch, round(avg(-ln(truth)), 6) AS val_loss,
        round(avg((predicted = y)::INT), 6) AS val_masked_accuracy,
        round(avg((predicted = y)::INT), 6) AS val_masked_accuracy_strict
    FROM (SELECT pair_id, pos, y, sum(p) FILTER (w = y) AS truth, arg_min(w, (-round(p, 12), w)) AS predicted FROM (
            SELECT s.pair_id, pos, s.w AS y, p_one.w, {MIXED.format(a=a)} AS p
            FROM s CROSS JOIN p_one {LOOKUPS.format(a=a)}) GROUP BY ALL)"""


# Brute force: every position of the test pairs against every token of the vocabulary.
sql("model_validation", " UNION ALL ".join(validation(i) for i in range(1, EPOCHS + 1)),
    *TURN_SMOOTHED, PAIRED, em(EPOCHS), *[scored(i) for i in range(1, EPOCHS + 1)],
    "s AS (SELECT pair_id, pos, c2, c1, w FROM positions WHERE split = 'test')")

# --- prompts, vectors, streams ----------------------------------------------------------------------------------

PROMPTS = "prompts AS (SELECT conv_id * 1000 + turn AS prompt_id, text FROM conversations WHERE role = 'user')"
CLEAN = f"regexp_replace(substr(lower(text), 1, {PROMPT_CHARACTERS}), '^{BLANK}+|{BLANK}+$', '', 'g')"
ROUTE = """CASE lower(text) WHEN ':s' THEN 'samples' WHEN ':ts' THEN 'temperature_samples' WHEN ':q' THEN 'quit'
    WHEN ':a' THEN 'architecture' WHEN ':p' THEN 'parameters'
    ELSE CASE WHEN starts_with(lower(text), ':') THEN 'rejected' ELSE 'prompt' END END"""

sql("prompt_normalize", f"SELECT prompt_id, {CLEAN} AS text FROM prompts", PROMPTS)
sql("prompt_route",
    f"""SELECT turn, {ROUTE} AS route, count(*) AS prompts FROM (
        SELECT turn, text FROM conversations UNION ALL SELECT turn, ':' || text FROM conversations UNION ALL
        SELECT turn, [':s', ':ts', ':q', ':A', ':p', ':ls', ' :s'][turn + 1] FROM conversations)
    WHERE text IS NOT NULL GROUP BY ALL""")
PROMPT_IDS = (
    PROMPTS,
    f"""prompt_tokens AS (SELECT prompt_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (
        SELECT prompt_id, regexp_extract_all(lower({CLEAN}), '{WORD_PATTERN}')[1:{PROMPT_LENGTH - 2}] AS t FROM prompts))""",
    """prompt_ids AS (SELECT p.prompt_id, coalesce(l, []::BIGINT[]) AS title FROM prompts p LEFT JOIN (
        SELECT prompt_id, list(coalesce(id, 3) ORDER BY pos) AS l FROM prompt_tokens LEFT JOIN vocab USING (token)
        GROUP BY prompt_id) f USING (prompt_id))""",
)
sql("stream_prompts",
    f"SELECT i.prompt_id, {ROUTE} AS route, {shown(framed('title', PROMPT_LENGTH), 'ids')} FROM prompt_ids i JOIN prompts USING (prompt_id)",
    TURNS, SPLIT, VOCAB, *PROMPT_IDS)

# Decoders by brute force: every step scores every token of the vocabulary for every open prompt.
PROMPT_SCORES = f"""prompt_sources AS (
    SELECT prompt_id, s, count(*)::DOUBLE / any_value(length) AS share FROM (
        SELECT prompt_id, unnest(l) AS s, len(l) AS length
        FROM (SELECT prompt_id, [x FOR x IN {framed('title', PROMPT_LENGTH)} IF x <> 0] AS l FROM prompt_ids)) GROUP BY ALL),
prompt_scores AS (SELECT prompt_id AS pair_id, w, sum(share * t) AS a
    FROM prompt_sources JOIN t{EPOCHS} USING (s) GROUP BY ALL)"""
DECODED = (*TURN_SMOOTHED, PAIRED, em(EPOCHS), *PROMPT_IDS, PROMPT_SCORES)
KEPT_WHOLE = "p_one p_two p_three left_two left_three prompt_scores prompt_ids vocab".split()


def greedy(name: str, steps: int, stop: bool) -> str:
    """``name(prompt_id, step, w)``: the most probable token at each step."""
    ended = "AND s.c1 <> 2" if stop else ""
    return f"""{name} AS (
        SELECT prompt_id AS pair_id, 0 AS step, 0::BIGINT AS c2, 1::BIGINT AS c1 FROM prompt_ids UNION ALL
        SELECT pair_id, step + 1, c1, arg_min(w, (-round(p, 12), w)) FROM (
            SELECT s.pair_id, s.step, s.c1, p_one.w, {MIXED.format(a='prompt_scores')} AS p
            FROM {name} s CROSS JOIN p_one {LOOKUPS.format(a='prompt_scores')} WHERE s.step < {steps} {ended})
        GROUP BY pair_id, step, c1)"""


def draw(*parts: str) -> str:
    text = " || '|' || ".join((f"'{SEED}'", *parts))
    return f"((('0x' || substr(md5({text}), 1, 12))::BIGINT + 0.5::DOUBLE) / {float(16**12)})"


def sampled(name: str, steps: int) -> str:
    """``name(prompt_id, step, w)``: one draw per step from the tempered distribution."""
    power = f"1 / {TEMPERATURE}::DOUBLE"
    k = "coalesce(left_three.k, 1) * coalesce(left_two.k, 1)"
    seen = "greatest(coalesce(p_three.p, 0), coalesce(left_three.k, 1) * coalesce(p_two.p, 0))"
    a = "coalesce(prompt_scores.a, 0)"
    return f"""tempered AS MATERIALIZED (
        SELECT w, pow(p, {power}) AS weight, sum(pow(p, {power})) OVER (ORDER BY w) AS upto, sum(pow(p, {power})) OVER () AS total FROM p_one),
    ranges AS MATERIALIZED (SELECT w, coalesce(lag(upto) OVER (ORDER BY w) / total, 0) AS low,
        CASE WHEN lead(w) OVER (ORDER BY w) IS NULL THEN 1 ELSE upto / total END AS high, total FROM tempered),
    {name} AS (
        SELECT prompt_id AS pair_id, 0 AS step, 0::BIGINT AS c2, 1::BIGINT AS c1 FROM prompt_ids UNION ALL
        SELECT pair_id, step + 1, c1, arg_max(w, (score, w)) FROM (
            SELECT pair_id, step, c1, w, ln(excess) - ln(-ln({draw('pair_id', 'step', 'w')})) AS score FROM (
                SELECT s.pair_id, s.step, s.c1, p_one.w,
                    pow(greatest(0.5 * {seen}, 0.5 * {k} * p_one.p) + 0.5 * {a}, {power}) - pow(0.5 * {k} * p_one.p, {power}) AS excess
                FROM {name} s CROSS JOIN p_one {LOOKUPS.format(a='prompt_scores')} WHERE s.step < {steps}) WHERE excess > 0
            UNION ALL
            SELECT s.pair_id, s.step, s.c1, r.w,
                ln(pow(0.5 * {k}, {power}) * r.total) - ln(-ln({draw('s.pair_id', 's.step', "'base'")}))
            FROM {name} s LEFT JOIN left_three ON left_three.c2 = s.c2 AND left_three.c1 = s.c1
            LEFT JOIN left_two ON left_two.c1 = s.c1
            JOIN ranges r ON {draw('s.pair_id', 's.step', "'place'")} >= r.low AND {draw('s.pair_id', 's.step', "'place'")} < r.high
            WHERE s.step < {steps})
        GROUP BY pair_id, step, c1)"""


def answers(name: str) -> str:
    """Text of the tokens behind the start."""
    return f"""SELECT i.prompt_id, coalesce(text, '') AS text FROM prompt_ids i LEFT JOIN (
        SELECT d.pair_id AS prompt_id, string_agg(v.token, ' ' ORDER BY step) AS text
        FROM {name} d JOIN vocab v ON v.id = d.c1 WHERE step > 0 GROUP BY 1) USING (prompt_id)"""


def decoded(name: str, select: str, *decoders: str) -> None:
    recursive(name, select, *DECODED, *decoders)
    for part in KEPT_WHOLE:
        ORACLES[name] = re.sub(rf"\b{part} AS \(", f"{part} AS MATERIALIZED (", ORACLES[name])


decoded("decode_greedy", answers("plain"), greedy("plain", ANSWER_LENGTH, True))
decoded("decode_greedy_fixed", answers("fixed"), greedy("fixed", ANSWER_LENGTH, False))
decoded("decode_sample", answers("drawn"), sampled("drawn", COMPARED_LENGTH))
decoded("stream_answers", f"SELECT prompt_id, a.text FROM ({answers('plain')}) a JOIN prompts p USING (prompt_id) WHERE {ROUTE.replace('text', 'p.text')} = 'prompt'",
    greedy("plain", PROMPT_LENGTH, True))
decoded("decoder_compare",
    f"""SELECT prompt_id, a.text AS plain, b.text AS sampled, c.text AS greedy, a.text = b.text AND a.text = c.text AS all_equal
    FROM ({answers('plain')}) a JOIN ({answers('drawn')}) b USING (prompt_id) JOIN ({answers('fixed')}) c USING (prompt_id)""",
    greedy("plain", COMPARED_LENGTH, True), sampled("drawn", COMPARED_LENGTH), greedy("fixed", COMPARED_LENGTH, False))
sql("stream_metrics", f"SELECT vec_id // {TRAIN_BATCH * 8} AS epoch, {LOSS}, {ACCURACY}, {STRICT} FROM scored GROUP BY 1",
    SCORED)

WIDTH = 64
VECTORS = f"""entries AS (SELECT id FROM vocab UNION ALL SELECT id FROM reserved),
table_size AS (SELECT count(*) AS rows FROM embeddings),
placed_vectors AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS place, embedding FROM embeddings),
vectors AS (SELECT id, [x::DOUBLE FOR x IN embedding] AS v FROM entries, table_size JOIN placed_vectors ON place = id % rows)"""


def angle(i: int) -> str:
    half = WIDTH // 2
    return f"{'sin' if i < half else 'cos'}(pos * pow(10000.0::DOUBLE, -{i % half} / {half}))"


def by_dimension(columns: list[str], source: str, group: str) -> str:
    """Grouped list of one value per dimension, unnested."""
    return f"""SELECT pair_id, unnest(range({WIDTH})) AS dim, unnest([round(x, 6) FOR x IN v]) AS value
        FROM (SELECT pair_id, [{', '.join(columns)}] AS v FROM {source} {group})"""


sql("embed_tokens",
    by_dimension([f"avg(v[{i + 1}] * 8 + {angle(i)})" for i in range(WIDTH)],
                 "placed JOIN vectors USING (id)", "GROUP BY pair_id"),
    *TURN_ENCODED, RESERVED, VECTORS,
    f"placed AS (SELECT * FROM (SELECT pair_id, unnest(input_ids) AS id, unnest(range({L})) AS pos FROM encoded) WHERE id <> 0)")
sql("positional_table",
    "SELECT pos, count(*) AS rows, "
    + ", ".join(f"round(sum({angle(i)}), 6) AS d{i}" for i in range(WIDTH))
    + " FROM placed GROUP BY pos",
    *TURN_ENCODED,
    f"placed AS (SELECT * FROM (SELECT unnest(input_ids) AS id, unnest(range({L})) AS pos FROM encoded) WHERE id <> 0)")


def attention(name: str, queries: str, keys: str, causal: bool = False) -> None:
    def side(column: str, alias: str) -> str:
        return f"""{alias} AS (SELECT pair_id, pos, v FROM (
            SELECT pair_id, unnest({column}) AS id, unnest(range(len({column}))) AS pos FROM encoded)
            JOIN vectors USING (id) WHERE id <> 0)"""

    limit = "AND k.pos <= q.pos" if causal else ""
    sql(name,
        f"SELECT pair_id, pos, {', '.join(f'round(sum(weight * v[{i + 1}]), 6) AS d{i}' for i in range(WIDTH))} FROM weighted GROUP BY ALL",
        *TURN_ENCODED, RESERVED, VECTORS, side(queries, "q"), side(keys, "k"),
        f"""scores AS (SELECT q.pair_id, q.pos, exp(list_dot_product(q.v, k.v) / sqrt({WIDTH})) AS e, k.v
            FROM q JOIN k ON k.pair_id = q.pair_id {limit})""",
        "weighted AS (SELECT pair_id, pos, v, e / sum(e) OVER (PARTITION BY pair_id, pos) AS weight FROM scores)")


attention("attend_cross", "targ_in", "input_ids")
attention("attend_self", "input_ids", "input_ids")
attention("attend_causal", "targ_in", "targ_in", causal=True)
