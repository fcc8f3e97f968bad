"""Queries over transcript text: normal form, quality, hotwords, fusion and the parsers of model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.functions import hotwords as hw
from sonoframe.functions import parsing, text
from sonoframe.operators import fusion, messages
from sonoframe.params import Params
from sonoframe.plans.registry import query, table

HOTWORDS = ("The", "ontion", "Ereand", "nd")
SQL_WORDS = "[" + ", ".join(f"'{w}'" for w in HOTWORDS) + "]"



def known() -> Column:
    return F.array(*[F.lit(w) for w in HOTWORDS])


#: DuckDB's \\b is ASCII only, so fillers are bounded by classes there, twice for neighbours that share a bound.
_FILL = "regexp_replace({0}, '(^|[^\\p{{L}}\\p{{N}}_])(um+|uh+|emm+)($|[^\\p{{L}}\\p{{N}}_])', '\\1 \\3', 'g')"


def sql_normal(c: str) -> str:
    low = f"lower(regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g'))"
    plain = f"regexp_replace(translate({low}, '，。；：？！', ',.;:?!'), '[`~^*_=+|\\\\]+', ' ', 'g')"
    return f"trim(regexp_replace({_FILL.format(_FILL.format(plain))}, '\\s+', ' ', 'g'))"


def sql_tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '[\\s,.;:!?]+'), lambda x: x <> '')"


def sql_run(words: str) -> str:
    return f"""(list_reduce(list_transform({words}, lambda x: {{'last': x, 'run': 1, 'most': 1}}), lambda a, x: {{'last': x.last,
      'run': CASE WHEN a.last = x.last THEN a.run + 1 ELSE 1 END,
      'most': greatest(a.most, CASE WHEN a.last = x.last THEN a.run + 1 ELSE 1 END)}})).most"""


SQL_ODD = """[^\\p{L}\\p{N} ,.;:!?''"\\-/]"""


def sql_quality(prefix: str, normal: str, words: str, forms: str, boost: float) -> str:
    """Columns of the quality measures, from names of a normal form and its tokens."""
    rep = f"CASE WHEN len({words}) = 0 THEN 0.0 ELSE (len({words}) - len(list_distinct({words})))::DOUBLE / len({words}) END"
    run = f"CASE WHEN len({words}) = 0 THEN 0.0 ELSE {sql_run(words)}::DOUBLE / len({words}) END"
    odd = f"CASE WHEN length({normal}) = 0 THEN 1.0 ELSE (length({normal}) - length(regexp_replace({normal}, '{SQL_ODD}', '', 'g')))::DOUBLE / length({normal}) END"
    hits = f"len(list_filter({forms}, lambda h: contains({normal}, h)))"
    score = f"greatest(0.0, least(1.0, 1.0::DOUBLE - least(0.45::DOUBLE, ({rep}) * 0.7::DOUBLE) - least(0.35::DOUBLE, ({run}) * 0.6::DOUBLE) - least(0.30::DOUBLE, ({odd}) * 0.5::DOUBLE) + least(0.35::DOUBLE, {hits} * {boost}::DOUBLE)))"
    pick = lambda x, e: f"CASE WHEN {normal} = '' THEN {e}::DOUBLE ELSE round(round(({x})::DOUBLE, 9), 4) END"
    return f"{pick(score, 0.0)} AS {prefix}score, {pick(rep, 1.0)} AS {prefix}repetition_ratio, {pick(run, 1.0)} AS {prefix}longest_run_ratio, {pick(odd, 1.0)} AS {prefix}abnormal_char_ratio, {pick(hits, 0.0)} AS {prefix}hotword_hits"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


@query("text_normalize", f"SELECT conv_id, turn, {sql_normal('text')} AS normal FROM conversations")
def text_normalize(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", text.normalize("text").alias("normal"))


@query("tokenize", f"SELECT doc_id, len(w)::INT AS n_tokens, w[1] AS first_token, w[len(w)] AS last_token FROM (SELECT doc_id, {sql_tokens(sql_normal('text'))} AS w FROM documents)")
def tokenize(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", text.tokens(text.normalize("text")).alias("w"))
    return words.select("doc_id", F.size("w").alias("n_tokens"), F.try_element_at("w", F.lit(1)).alias("first_token"), F.try_element_at("w", F.lit(-1)).alias("last_token"))


def _ratio(name: str, native, sql: str):
    @query(name, f"SELECT doc_id, round(({sql})::DOUBLE, 6) AS ratio FROM (SELECT doc_id, n, {sql_tokens('n')} AS w FROM (SELECT doc_id, {sql_normal('text')} AS n FROM documents))")
    def run(spark, sf_dir):
        docs = table(spark, sf_dir, "documents").select("doc_id", text.normalize("text").alias("n"))
        return docs.withColumn("w", text.tokens(F.col("n"))).select("doc_id", F.round(native(F.col("n"), F.col("w")), 6).alias("ratio"))


_ratio("repetition_ratio", lambda n, w: text.repetition_ratio(w), "CASE WHEN len(w) = 0 THEN 0.0 ELSE (len(w) - len(list_distinct(w)))::DOUBLE / len(w) END")
_ratio("longest_run", lambda n, w: text.longest_run_ratio(w), f"CASE WHEN len(w) = 0 THEN 0.0 ELSE {sql_run('w')}::DOUBLE / len(w) END")
_ratio("abnormal_chars", lambda n, w: text.abnormal_ratio(n), f"CASE WHEN length(n) = 0 THEN 1.0 ELSE (length(n) - length(regexp_replace(n, '{SQL_ODD}', '', 'g')))::DOUBLE / length(n) END")


SQL_FORMS = f"list_transform({SQL_WORDS}, lambda h: {sql_normal('h')})"


@query("quality_score", f"SELECT conv_id, turn, {sql_quality('', 'n', 'w', SQL_FORMS, Params().hotword_boost)} FROM (SELECT conv_id, turn, n, {sql_tokens('n')} AS w FROM (SELECT conv_id, turn, {sql_normal('text')} AS n FROM conversations))")
def quality_score(spark, sf_dir):
    df = turns(spark, sf_dir).withColumn("n", text.normalize("text"))
    return df.select("conv_id", "turn", text.quality(F.col("n"), hw.normalized(known()), Params().hotword_boost).alias("q")).select("conv_id", "turn", "q.*")


# -- hotwords: each turn's first words stand for a list that a client sent

SQL_LIST = "string_split(text, ' ')"


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", "text", F.split(F.coalesce("text", F.lit("")), " ").alias("words"))


@query("hotword_sanitize", r"""
SELECT conv_id, turn, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: list_position(w, p[1]) = p[2]), lambda p: p[1]), '|') AS words
FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(coalesce(text, ''), ' '), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS w FROM conversations)""")  # fmt: skip
def hotword_sanitize(spark, sf_dir):
    return listed(spark, sf_dir).select("conv_id", "turn", F.array_join(hw.sanitize(F.col("words")), "|").alias("words"))


@query("hotword_hits", f"SELECT conv_id, turn, len(list_filter({SQL_FORMS}, lambda h: contains(n, h)))::INT AS hits FROM (SELECT conv_id, turn, {sql_normal('text')} AS n FROM conversations)")
def hotword_hits(spark, sf_dir):
    df = turns(spark, sf_dir).withColumn("n", text.normalize("text"))
    return df.select("conv_id", "turn", text.hotword_hits(F.col("n"), hw.normalized(known())).alias("hits"))


@query("hotword_filter_reported", f"SELECT conv_id, turn, array_to_string(list_filter(string_split(coalesce(text, ''), ' '), lambda x: list_contains({SQL_FORMS}, {sql_normal('x')})), '|') AS kept FROM conversations")
def hotword_filter_reported(spark, sf_dir):
    return listed(spark, sf_dir).select("conv_id", "turn", F.array_join(hw.keep_reported(F.col("words"), known()), "|").alias("kept"))


@query("hotword_merge", f"SELECT conv_id, turn, n::INT AS added, (n + {len(HOTWORDS)})::INT AS total FROM (SELECT conv_id, turn, len(list_filter(list_distinct(list_filter(list_transform(string_split(coalesce(text, ''), ' '), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')), lambda x: NOT list_contains({SQL_WORDS}, x))) AS n FROM conversations)")
def hotword_merge(spark, sf_dir):
    return listed(spark, sf_dir).select("conv_id", "turn", hw.merge(known(), F.col("words")).alias("m")).select("conv_id", "turn", "m.added", "m.total")


@query("hotword_short", "SELECT conv_id, turn, len(list_filter(string_split(coalesce(text, ''), ' '), lambda x: length(x) < 10))::INT AS n FROM conversations")
def hotword_short(spark, sf_dir):
    return listed(spark, sf_dir).select("conv_id", "turn", F.size(hw.short_enough(F.col("words"))).alias("n"))


@query("highlighted_html", r"""
SELECT conv_id, turn, regexp_replace(replace(replace(replace(coalesce(text, '') || '<' || coalesce(role, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(then|the|er|USER|ontion)', '<mark class="hotword-hit">\1</mark>', 'gi') AS html FROM conversations""")  # fmt: skip
def highlighted_html(spark, sf_dir):
    """Texts as HTML with several hotwords marked, some within others, whatever their case and the spaces around them."""
    shown = F.concat(F.coalesce("text", F.lit("")), F.lit("<"), F.coalesce("role", F.lit("")))
    words = F.array(*[F.lit(w) for w in ("the", " Then ", "er", "user", "ONTION", "")])
    marked = turns(spark, sf_dir).select("conv_id", "turn", shown.alias("shown")).withColumn("spans", hw.highlight_spans("shown", words))
    return marked.select("conv_id", "turn", hw.highlighted(F.col("shown"), F.col("spans")).alias("html"))


@query("highlight_count", "SELECT conv_id, turn, ((length(coalesce(text, '')) - length(replace(lower(coalesce(text, '')), 'ontion', ''))) // 6)::INT AS hits FROM conversations")
def highlight_count(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", hw.highlight_count(F.col("text"), F.array(F.lit("Ontion"))).alias("hits"))


# -- two hypotheses for each turn: the text itself, and an edit of it that meets every branch of the decision

def hypotheses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = turns(spark, sf_dir).withColumns({"segment_id": F.concat_ws("-", "conv_id", "turn"), "text": F.coalesce("text", F.lit("")), "k": (F.col("conv_id") * 3 + F.col("turn")) % 7})
    words = F.split("text", " ")
    edited = F.when(F.col("k") == 0, "").when(F.col("k") == 1, F.array_join(F.slice(words, 2, 100_000), " ")).when(F.col("k") == 2, F.reverse("text")).otherwise(F.col("text"))
    heard = F.when(F.col("k") == 3, F.concat(F.lit("go "), F.repeat(F.lit("go "), 9))).when(F.col("k") == 4, "").otherwise(F.col("text"))
    first = base.where((F.col("conv_id") + F.col("turn")) % 11 != 0).select("segment_id", heard.alias("text"), words.alias("reported"))
    second = base.where((F.col("conv_id") + F.col("turn")) % 13 != 0).select("segment_id", edited.alias("text"), words.alias("reported"))
    return first, second


SQL_PAIRS = """
base AS (SELECT conv_id, turn, conv_id || '-' || turn AS segment_id, coalesce(text, '') AS text, (conv_id * 3 + turn) % 7 AS k FROM conversations),
p AS (SELECT segment_id, CASE k WHEN 3 THEN 'go ' || repeat('go ', 9) WHEN 4 THEN '' ELSE text END AS text, string_split(text, ' ') AS reported FROM base WHERE (conv_id + turn) % 11 <> 0),
s AS (SELECT segment_id, CASE k WHEN 0 THEN '' WHEN 1 THEN array_to_string(string_split(text, ' ')[2:], ' ') WHEN 2 THEN reverse(text) ELSE text END AS text, string_split(text, ' ') AS reported FROM base WHERE (conv_id + turn) % 13 <> 0),
pairs AS (SELECT segment_id, coalesce(p.text, '') AS pt, coalesce(s.text, '') AS st, p.segment_id IS NOT NULL AS p_there, s.segment_id IS NOT NULL AS s_there FROM p FULL JOIN s USING (segment_id))"""


@query("dual_outer_join", f"WITH {SQL_PAIRS} SELECT segment_id, p_there AS primary_there, s_there AS secondary_there, length(pt)::INT AS n_primary, length(st)::INT AS n_secondary FROM pairs")
def dual_outer_join(spark, sf_dir):
    pairs = fusion.pair_hypotheses(*hypotheses(spark, sf_dir))
    size = lambda c: F.char_length(F.coalesce(c, F.lit("")))
    return pairs.select("segment_id", "primary_there", "secondary_there", size("primary_text").alias("n_primary"), size("secondary_text").alias("n_secondary"))


@query("secondary_silence_gate", f"WITH {SQL_PAIRS} SELECT segment_id, text FROM p WHERE segment_id IN (SELECT segment_id FROM s WHERE text <> '')")
def secondary_silence_gate(spark, sf_dir):
    return fusion.heard(*hypotheses(spark, sf_dir)).select("segment_id", "text")


def token_overlap() -> Column:
    """Likeness that SQL can repeat: shared over all distinct tokens."""
    a, b = text.tokens(F.col("norm_primary")), text.tokens(F.col("norm_secondary"))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


_D = Params()


SQL_FUSED = f"""
WITH {SQL_PAIRS},
normal AS (SELECT *, {sql_normal('pt')} AS np, {sql_normal('st')} AS ns, [x FOR x IN {SQL_FORMS}] AS forms FROM pairs),
words AS (SELECT *, {sql_tokens('np')} AS wp, {sql_tokens('ns')} AS ws FROM normal),
scored AS (SELECT *, {sql_quality('p_', 'np', 'wp', 'forms', _D.hotword_boost)}, {sql_quality('s_', 'ns', 'ws', 'forms', 0.0)},
  CASE WHEN len(list_distinct(list_concat(wp, ws))) = 0 THEN 0.0 ELSE len(list_distinct(list_intersect(wp, ws)))::DOUBLE / len(list_distinct(list_concat(wp, ws))) END AS sim FROM words),
chosen AS (SELECT *, CASE WHEN st = '' THEN 1 WHEN pt = '' THEN 2 WHEN p_hotword_hits > 0 THEN 3
  WHEN p_repetition_ratio > {_D.max_repetition} OR (1 - sim > {_D.disagreement_threshold} AND p_hotword_hits <= s_hotword_hits) THEN 4
  WHEN sim >= {_D.similarity_threshold} AND p_score >= {_D.min_primary_score} THEN 5
  WHEN p_score >= s_score + {_D.score_margin}::DOUBLE AND p_score >= {_D.min_primary_score} THEN 6 ELSE 7 END AS branch FROM scored)"""


@query("fusion_decision", f"""{SQL_FUSED}
SELECT segment_id, CASE WHEN branch = 1 THEN '' WHEN branch IN (3, 5, 6) THEN pt ELSE st END AS text,
  ['silence', 'secondary_only', 'primary_hotword_hit', 'secondary_qwen_fallback', 'primary_agreement', 'primary_hotword_advantage', 'secondary_qwen_fallback'][branch] AS selected,
  ['secondary_empty_force_silence', 'primary_empty', 'primary_hits_hotword', 'primary_hallucination_risk', 'high_similarity_and_primary_valid', 'primary_score_margin', 'primary_not_confident'][branch] AS reason,
  CASE WHEN pt <> '' AND st <> '' THEN round(sim, 4) END AS similarity,
  CASE WHEN pt <> '' AND st <> '' THEN p_score ELSE 0.0 END AS primary_score,
  CASE WHEN pt <> '' AND st <> '' THEN s_score WHEN st <> '' THEN 1.0 ELSE 0.0 END AS secondary_score
FROM chosen""")  # fmt: skip
def fusion_decision(spark, sf_dir):
    df = fusion.decide(fusion.pair_hypotheses(*hypotheses(spark, sf_dir)), hotwords=known(), similarity=token_overlap())
    return df.select("segment_id", *[F.col(f"fused.{c}") for c in ("text", "selected", "reason", "similarity", "primary_score", "secondary_score")])


@query("text_similarity")
def text_similarity(spark, sf_dir):
    """Ratio of matching blocks of the two hypotheses, which SQL has no twin of."""
    pairs = fusion.pair_hypotheses(*hypotheses(spark, sf_dir))
    return pairs.select("segment_id", F.round(text.sequence_ratio(text.normalize("primary_text"), text.normalize("secondary_text")), 6).alias("similarity"))


@query("final_messages")
def final_messages(spark, sf_dir):
    """Two hypotheses a segment, fused, as JSON messages; the silent ones are left out."""
    df = fusion.final_text(fusion.pair_hypotheses(*hypotheses(spark, sf_dir)), hotwords=known())
    return df.where(F.col("final") != "").select("segment_id", F.col("fused.selected").alias("selected"), messages.final(F.col("final"), F.lit("English")).alias("message"))


# -- model answers, made of the turns

@query("parse_asr_output", r"""
WITH made AS (SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^ | $', '', 'g') AS body, role, (conv_id + turn) % 6 AS k FROM conversations),
shown AS (SELECT *, CASE WHEN regexp_matches(body, '(?i)(language|hotwords|transcription)') THEN 'hidden ' || length(body) ELSE body END AS said FROM made)
SELECT conv_id, turn, CASE k WHEN 3 THEN 'the language: ' || role || ' hotwords: ' || said WHEN 4 THEN CASE WHEN said = '' THEN 'transcription:' ELSE said END WHEN 1 THEN CASE WHEN said = '' THEN 'Hotwords: ' || role || ' ，x;' ELSE said END WHEN 5 THEN '' ELSE said END AS transcription,
  CASE WHEN k = 0 THEN 'English' WHEN k = 5 THEN 'Hotwords: a' END AS detected_language,
  CASE WHEN k < 2 THEN role || '|x' WHEN k = 5 THEN 'a' ELSE '' END AS hotwords FROM shown""")  # fmt: skip
def parse_asr_output(spark, sf_dir):
    """Every turn as a model's answer: hotwords before and after the transcript, none, labels within a line, one field only, and a language line without a value."""
    body = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    said = F.when(F.col("body").rlike("(?i)(language|hotwords|transcription)"), F.concat(F.lit("hidden "), F.char_length("body"))).otherwise(F.col("body"))
    df = turns(spark, sf_dir).withColumns({"body": body, "k": (F.col("conv_id") + F.col("turn")) % 6}).withColumn("said", said)
    k, two = F.col("k"), F.concat("role", F.lit(" ，x;"))
    raw = (
        F.when(k == 0, F.concat(F.lit("Language: English\nHotwords: "), two, F.lit("\nTranscription: "), "said"))
        .when(k == 1, F.concat(F.lit("Transcription: "), "said", F.lit("\\nHotwords: "), two))
        .when(k == 2, F.col("said"))
        .when(k == 3, F.concat(F.lit("the language: "), "role", F.lit(" hotwords: "), "said"))
        .when(k == 4, F.concat(F.lit("transcription:"), "said"))
        .otherwise(F.lit("Language:\nHotwords: a\nTranscription:"))
    )
    got = df.select("conv_id", "turn", parsing.parse_transcript(raw).alias("r"))
    return got.select("conv_id", "turn", "r.transcription", "r.detected_language", F.array_join("r.reported_hotwords", "|").alias("hotwords"))


def _sql_emotion(c: str) -> str:
    names = parsing.EMOTIONS
    exact = " ".join(f"WHEN regexp_replace(lower({c}), '[.,!?;:\"''\\s]+$', '') = '{n.lower()}' THEN '{n}'" for n in names)
    within = " ".join(f"WHEN regexp_matches(lower({c}), '(^|[^\\p{{L}}\\p{{N}}_]){n.lower().split('/')[0]}($|[^\\p{{L}}\\p{{N}}_])') THEN '{n}'" for n in names)
    return f"CASE {exact} {within} ELSE '' END"


_NAMES = "['Happy', 'Sad.', 'ANGRY', 'other/complex', 'so fearful, with fear and surprise', '???', 'Neutral! ', 'disgusting']"


@query("parse_emotion_ser", f"SELECT event_id, {_sql_emotion('raw')} AS label FROM (SELECT event_id, {_NAMES}[1 + event_id % 8] AS raw FROM events)")
def parse_emotion_ser(spark, sf_dir):
    raw = F.element_at(F.array(*[F.lit(x.strip("'")) for x in _NAMES[1:-1].split("', '")]), (F.col("event_id") % 8 + 1).cast("int"))
    shown = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('```json\n{"label": "'), raw, F.lit('"}\n```'))).otherwise(raw)
    return table(spark, sf_dir, "events").select("event_id", parsing.parse_emotion(shown, F.lit("SER"))["label"].alias("label"))


@query("parse_emotion_sec", "SELECT conv_id, turn, CASE WHEN regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') = '' THEN '' ELSE 'A sad voice: ' || role END AS summary, CASE WHEN regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') = '' THEN '' ELSE 'Sad' END AS label FROM conversations")
def parse_emotion_sec(spark, sf_dir):
    said = F.concat(F.lit("A sad voice: "), "role")
    raw = F.when(F.trim(text.strip(F.coalesce("text", F.lit("")))) == "", "  ").when(F.col("turn") % 2 == 0, F.to_json(F.struct(said.alias("summary")))).otherwise(said)
    return turns(spark, sf_dir).select("conv_id", "turn", parsing.parse_emotion(raw, F.lit("sec")).alias("r")).select("conv_id", "turn", F.col("r.text").alias("summary"), F.col("r.label").alias("label"))


@query("parse_hotword_json", "SELECT conv_id, turn, array_to_string([role, 'k' || turn], '|') AS words FROM conversations")
def parse_hotword_json(spark, sf_dir):
    words = F.array("role", F.concat(F.lit("k"), F.col("turn").cast("string")), "role")
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```json\n"), F.to_json(F.struct(words.alias("hotwords"))), F.lit("\n```"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("Sure: "), F.to_json(F.struct(words.alias("hotwords"))), F.lit(" !"))).otherwise(F.array_join(words, "，"))
    return turns(spark, sf_dir).select("conv_id", "turn", F.array_join(parsing.parse_hotword_answer(raw), "|").alias("words"))


@query("map_language", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'zh' THEN 'Chinese' WHEN 'cn' THEN 'Chinese' WHEN 'id' THEN 'Indonesian' WHEN 'th' THEN 'Thai' ELSE 'N/A' END AS language FROM documents")
def map_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", parsing.map_language(F.concat(F.lit(" "), F.upper("lang"))).alias("language"))


@query("normalize_mode", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'sec' ELSE 'ser' END AS mode FROM events")
def normalize_mode(spark, sf_dir):
    mode = F.when(F.col("event_type") == "click", " SEC ").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", parsing.normalize_mode(mode).alias("mode"))


@query("prompts", "SELECT conv_id, turn, 'Transcribe the following audio.' || chr(10) || 'Language: ' || role || chr(10) || 'Hotwords: ' || role || ',x' AS prompt, chr(10) || 'Speaker traits: ' || role || '.' AS traits, chr(10) || 'Hotwords: ' || role || ',x.' AS words FROM conversations")
def prompts(spark, sf_dir):
    words = F.array("role", F.lit("x"))
    return turns(spark, sf_dir).select("conv_id", "turn", messages.primary_prompt(F.col("role"), words).alias("prompt"), messages.traits_part(F.concat(F.lit(" "), "role")).alias("traits"), messages.hotwords_part(words).alias("words"))
