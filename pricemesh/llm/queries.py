"""The registered queries of this folder and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pricemesh.llm import (
    chat,
    decontaminate,
    line_runs,
    mixing,
    packing,
    prefix_trie,
    quality_model,
    rules,
    secret_spans,
    simhash,
    spelling,
    toxicity,
    wrappers,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _bounds_sql() -> str:
    parts = []
    for r in rules.THRESHOLDS:
        parts += [f"{r.measure} >= {r.low}"] * (r.low is not None) + [f"{r.measure} <= {r.high}"] * (r.high is not None)
    return " AND ".join(parts)


_STOPS = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)
OP8_SQL = rf"""
WITH split AS (
    SELECT doc_id, coalesce(text, '') AS body, {_words_sql("coalesce(text, '')")} AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents),
grams AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n
    FROM (SELECT doc_id, i, [words[i], words[i + 1], words[i + 2]] AS g
          FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split))),
repeats AS (
    SELECT doc_id, count(*) AS n_repeat_words
    FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE n > 1) GROUP BY doc_id),
counts AS (
    SELECT doc_id, len(words) AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
           length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words,
           length(regexp_replace(body, '[\p{{L}}\p{{N}}\x20\x09-\x0D]+', '', 'g')) AS marks,
           length(regexp_replace(body, '\P{{Lu}}+', '', 'g')) AS uppers,
           len(list_filter(words, lambda w: lower(w) IN ({_STOPS}))) AS stops
    FROM split LEFT JOIN repeats USING (doc_id)),
ratios AS (
    SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio,
           coalesce(marks / nullif(word_chars, 0), 0) AS mark_ratio, coalesce(stops / nullif(n_words, 0), 0) AS stop_ratio,
           coalesce(uppers / nullif(word_chars, 0), 0) AS upper_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
           n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
    FROM counts)
SELECT doc_id, cast(n_words AS bigint) AS n_words, cast(word_chars AS bigint) AS word_chars, cast(n_symbols AS bigint) AS n_symbols,
       cast(n_dup_lines AS bigint) AS n_dup_lines, cast(n_repeat_words AS bigint) AS n_repeat_words, base_failed,
       NOT base_failed AND {_bounds_sql()} AS kept
FROM ratios"""


@register(OP8_SQL)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@register()
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _plain_words_sql(text: str) -> str:
    lowered = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"coalesce(regexp_extract_all({lowered}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'), [])"


OP7_SQL = rf"""
WITH docs AS (SELECT doc_id, {_plain_words_sql("text")} AS words FROM documents),
items AS (SELECT cast(item_id AS varchar) AS item_id, {_plain_words_sql("text")} AS words FROM benchmark),
phrases AS (
    SELECT DISTINCT item_id, least(len(words), {decontaminate.WINDOW}) AS l, array_to_string(words[i : i + least(len(words), {decontaminate.WINDOW}) - 1], ' ') AS gram
    FROM (SELECT *, unnest(range(1, greatest(2, len(words) - {decontaminate.WINDOW} + 2))) AS i FROM items WHERE len(words) > 0)),
grams AS (
    SELECT doc_id, i, l, array_to_string(words[i : i + l - 1], ' ') AS gram
    FROM (SELECT doc_id, words, l, unnest(range(1, len(words) - l + 2)) AS i FROM docs, (SELECT DISTINCT l FROM phrases))),
found AS (SELECT DISTINCT doc_id, i, l, item_id FROM grams JOIN phrases USING (l, gram)),
hits AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + l)) AS p FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1),
places AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS p FROM docs),
rare AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(c, 0), w) AS r, count(*) OVER (PARTITION BY item_id) AS k
                   FROM (SELECT DISTINCT item_id, unnest(words) AS w FROM items) LEFT JOIN (SELECT w, count(*) AS c FROM places GROUP BY 1) USING (w))
    WHERE r <= {decontaminate.NEAR_TERMS} AND k > 1),
spots AS (SELECT item_id, r, least(k, {decontaminate.NEAR_TERMS}) AS k, doc_id, p FROM rare JOIN places USING (w)),
near AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_near_items
    FROM (SELECT a.doc_id, a.item_id, a.p FROM spots a JOIN spots b ON b.item_id = a.item_id AND b.doc_id = a.doc_id AND b.r > 1
              AND b.p BETWEEN a.p - {decontaminate.NEAR_WORDS} AND a.p + {decontaminate.NEAR_WORDS}
          WHERE a.r = 1 GROUP BY a.doc_id, a.item_id, a.p, a.k HAVING count(DISTINCT b.r) = a.k - 1) GROUP BY 1)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(words), false) AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near USING (doc_id)"""


@register(OP7_SQL)
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
        F.size(F.array_distinct(F.transform("near", lambda x: x["item_id"]))).cast("bigint").alias("n_near_items"),
    )


#: An example target: which domain a source belongs to goes by its number; weights are parts of the budget.
DOMAINS = ("web", "forum", "reference", "code")
MIX_WEIGHTS = {
    "domain": {"web": 50, "forum": 10, "reference": 25, "code": 15},
    "lang": {"en": 40, "de": 20, "fr": 20, "es": 20},
}
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 80, 3, 7


def domain_of_source() -> Column:
    number = F.regexp_extract("source", "([0-9]+)$", 1)
    at = F.pmod(F.when(number != "", number.cast("bigint")), F.lit(len(DOMAINS)))
    return F.element_at(F.array(*[F.lit(x) for x in DOMAINS]), (at + 1).cast("int"))


def _weight_sql(level: str) -> str:
    known = MIX_WEIGHTS.get(level, {})
    return "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in known.items()) + " ELSE 1 END" if known else "1"


def _level_sql(name: str, path: list[str], parent: str) -> str:
    """Budget of every node of a level, as share; parent: the level above, or the whole budget."""
    keys, above = ", ".join(path), ", ".join(path[:-1])
    part = f"PARTITION BY {above}" if above else ""
    source = f"JOIN (SELECT {above}, share AS budget FROM {parent}) USING ({above})" if above else "CROSS JOIN whole"
    return f"""
{name}_nodes AS (
    SELECT *, {_weight_sql(path[-1])} AS weight
    FROM (SELECT {keys}, cast(sum(tokens) * {MIX_EPOCHS} AS hugeint) AS supply FROM leaves GROUP BY {keys}) {source}),
{name}_filled AS (
    SELECT *, coalesce(sum(supply) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent_before,
           sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
    FROM {name}_nodes
    WINDOW o AS ({part} ORDER BY cast(supply AS double) / cast(weight AS double), {path[-1]})),
{name}_tested AS (
    SELECT *, supply * open_weight <= (budget - spent_before) * weight AS filled FROM {name}_filled),
{name} AS (
    SELECT {keys}, CASE WHEN filled THEN supply ELSE least(supply, greatest(0, budget
               - coalesce(sum(supply) FILTER (filled) OVER g, 0)) * weight // sum(weight) FILTER (NOT filled) OVER g) END AS share
    FROM {name}_tested WINDOW g AS ({part}))"""


OP6_SQL = rf"""
WITH tokens AS (
    SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           coalesce(({list(DOMAINS)})[cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS bigint) % {len(DOMAINS)} + 1], '') AS domain,
           coalesce(len({_words_sql("text")}), 0) AS n_tokens
    FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM tokens GROUP BY ALL),
whole AS (SELECT cast(sum(tokens) * {MIX_PERCENT} // 100 AS hugeint) AS budget FROM leaves),
{_level_sql("by_domain", ["domain"], "whole")},
{_level_sql("by_lang", ["domain", "lang"], "by_domain")},
{_level_sql("by_source", ["domain", "lang", "source"], "by_lang")},
targets AS (
    SELECT domain, lang, source, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS full_epochs,
           CASE WHEN tokens > 0 THEN share % tokens ELSE 0 END AS rest
    FROM leaves JOIN by_source USING (domain, lang, source)),
keyed AS (
    SELECT *, md5('{MIX_SEED}:' || cast(full_epochs AS varchar) || ':' || coalesce(cast(doc_id AS varchar), '')) AS key
    FROM tokens JOIN targets USING (domain, lang, source)),
reached AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS reach FROM keyed)
SELECT doc_id, domain, lang, source, cast(n_tokens AS bigint) AS n_tokens,
       cast(full_epochs + CASE WHEN rest > 0 AND reach <= rest THEN 1 ELSE 0 END AS bigint) AS copies
FROM reached WHERE full_epochs > 0 OR (rest > 0 AND reach <= rest)"""


@register(OP6_SQL)
def op6_mix_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    picked = mixing.mix(docs, domain_of_source(), MIX_PERCENT, MIX_WEIGHTS, max_epochs=MIX_EPOCHS, seed=MIX_SEED)
    return picked.select("doc_id", "domain", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "n_tokens", "copies")


@register()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@register()
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_spans.scan(docs, secret_spans.train(docs))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def text(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans")
    )


def _escaped_sql(text: str) -> str:
    out = f"replace({text}, chr(92), chr(92) || chr(92))"
    for control in chat.CONTROLS:
        out = f"replace({out}, '{control}', '{control[0]}' || chr(92) || '{control[1:]}')"
    return out


OP2_SQL = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT cast(conv_id AS bigint) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       cast(coalesce(sum(length(text)) FILTER (role = '{chat.LOSS}'), 0) AS bigint) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{chat.LOSS}'), '')) AS loss_sha256,
       cast(sum({len(chat.TURN + chat.BODY + chat.END)} + length({_escaped_sql("role")}) + length({_escaped_sql("text")})) AS bigint) AS formatted_chars
FROM turns GROUP BY conv_id"""


@register(OP2_SQL)
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sample = [(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    extra = spark.createDataFrame(sample, "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.format_chats(turns.unionByName(extra)))


@register()
def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(table(spark, sf_dir, "pages"))


@register()
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_runs.deduplicate(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines_cut", F.length("text").cast("bigint").alias("n_chars_left"), "text")


def trusted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that someone has marked as good text."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


@register()
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_model.judge(table(spark, sf_dir, "documents"), trusted_rows(spark, sf_dir))
    return judged.select("doc_id", "lang", "perplexity", F.col("most").alias("limit"), "kept")


def _crc32_sql(octets: str) -> str:
    """CRC-32 of a list of octets: eight shifts each, the first after the octet is mixed in."""
    bits = f"flatten(list_transform({octets}, lambda o: [o, 0, 0, 0, 0, 0, 0, 0]))"
    step = "CASE WHEN xor(a, x) & 1 = 1 THEN xor(xor(a, x) >> 1, 3988292384) ELSE xor(a, x) >> 1 END"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {bits}), lambda a, x: {step}), 4294967295)"


def _octets_sql(text: str) -> str:
    """UTF-8 octets of a text whose code points are below 2048."""
    return (
        f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::bigint]"
        " ELSE [(192 | (ord(c) >> 6))::bigint, (128 | (ord(c) & 63))::bigint] END))"
    )


#: Conversations whose ids agree but for the remainder by OPENING share up to three opening turns.
OPENING, OPENING_TURNS = 20, 4
OP11_SQL = rf"""
WITH turns AS (
    SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
picked AS (
    SELECT *, c - ((c % {OPENING}) + {OPENING}) % {OPENING} AS base, {_crc32_sql(_octets_sql("cast(c AS varchar)"))} % {OPENING_TURNS} AS h FROM turns),
rebuilt AS (
    SELECT p.c, list_concat(list_slice(coalesce(b.own, []), 1, h), list_slice(p.own, h + 1, len(p.own))) AS seq
    FROM picked p LEFT JOIN turns b ON b.c = p.base),
members AS (SELECT c, len(seq) AS n, d, list_slice(seq, 1, d) AS node FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)),
nodes AS (
    SELECT node, d, min(c) AS low, count(*) AS n_convs, string_agg(cast(c AS varchar), ',' ORDER BY c) FILTER (n = d) AS ends
    FROM members GROUP BY node, d),
kids AS (SELECT list_slice(node, 1, d - 1) AS node, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
whole AS (
    SELECT nodes.*, coalesce(k, 0) AS k, CASE WHEN d > 0 THEN (n_convs - 1) * len({_words_sql("node[d].t")}) ELSE 0 END AS saved
    FROM nodes LEFT JOIN kids USING (node, d)),
sums AS (
    SELECT list_slice(node, 1, a) AS node, a AS d, count(*) FILTER (k = 0) AS n_leaves, sum(saved) AS saved_tokens
    FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM whole) GROUP BY ALL)
SELECT w.low AS conv_id, w.d AS depth, p.low AS parent_conv_id, w.n_convs, w.k AS n_children, n_leaves, cast(saved_tokens AS bigint) AS saved_tokens,
       sha256(coalesce(w.ends, '')) AS ends_sha256
FROM whole w JOIN sums USING (node, d) LEFT JOIN nodes p ON p.d = w.d - 1 AND p.node = list_slice(w.node, 1, w.d - 1)"""


@register(OP11_SQL)
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prefix_trie.conversations(prefix_trie.turn_keys(table(spark, sf_dir, "conversations")))
    opening = F.crc32(F.col("conv_id").cast("string")) % OPENING_TURNS
    return prefix_trie.trie(prefix_trie.with_shared_openings(own, OPENING, opening)).drop("node_id", "parent_id")


TYPO_EVERY = 97
_RUN = "translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = rf"""
WITH found AS (
    SELECT key, {_RUN} AS w, count(*) AS n
    FROM (SELECT coalesce(cast(doc_id AS varchar), '') AS key, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
    GROUP BY ALL),
hashed AS (SELECT w, n, {_crc32_sql(_octets_sql("key || ':' || w"))} AS h FROM found),
spoiled AS (
    SELECT n, CASE WHEN h % {TYPO_EVERY} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed),
words AS (
    SELECT word, cast(sum(n) AS bigint) AS n FROM spoiled WHERE length(word) >= {spelling.LEAST_LETTERS}
    GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
cuts AS (SELECT word, n, length(word) AS l, i, substr(word, 1, i - 1) || substr(word, i + 1) AS left_over
         FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
replaced AS (SELECT a.word, b.word AS other FROM cuts a JOIN cuts b USING (l, i, left_over) WHERE a.word <> b.word),
deleted AS (SELECT DISTINCT c.word, w.word AS other FROM cuts c JOIN words w ON w.word = c.left_over),
near AS (SELECT * FROM replaced UNION ALL SELECT * FROM deleted UNION ALL SELECT other, word FROM deleted),
ranked AS (
    SELECT near.word, other, w.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
           row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, other) AS r
    FROM near JOIN words w ON w.word = other),
formed AS (
    SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {spelling.FACTOR} * n THEN other END AS form,
           CASE WHEN other_n >= {spelling.FACTOR} * n THEN other_n END AS form_n
    FROM words LEFT JOIN (SELECT * FROM ranked WHERE r = 1) AS best ON best.word = words.word),
walk AS (
    WITH RECURSIVE go AS (
        SELECT word, word AS here, form AS next FROM formed
        UNION ALL SELECT go.word, go.next, f.form FROM go JOIN formed f ON f.word = go.next)
    SELECT word, here AS root FROM go WHERE next IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN walk USING (word)"""


@register(OP12_SQL)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(table(spark, sf_dir, "documents"), typo_every=TYPO_EVERY)
    return spelling.group(words).select("word", "form", "root", "n", "n_near", "form_n")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register()
def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
