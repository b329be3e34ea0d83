"""Queries: segmentation, tagging, document records, fine-tuning data, parsers, logits."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolake import providers
from annolake.functions import scores
from annolake.functions.text import parse_label, split_term_label
from annolake.operators import anchors, docred, finetune, records, relations, segment, sentences, spans
from annolake.plans.oracle import LABEL_LIST, hashed, quoted, tokenised
from annolake.plans.registry import query
from annolake.schema import LABELS, PREDICATES, VALID_RELATIONS, valid_relations
from annolake.sources import fixtures as fx
from annolake.streaming import resume

SPAN = spans.SPAN


texts = fx.texts  # dealt by paper, for what is sorted or joined by paper


def read(spark, sf_dir):
    """Sections as they are read: where each text is worked on by itself, nothing needs to be dealt."""
    return spans.sections(fx.papers(spark, sf_dir))


@query("SELECT paper_id, location, CAST(length(text) AS BIGINT) AS n, text = '' AS is_empty FROM sections")
def sections_split(spark, sf_dir):
    return read(spark, sf_dir).select("paper_id", "location", F.length("text").alias("n"), (F.col("text") == "").alias("is_empty"))


@query("SELECT paper_id, location, count(*) AS n, min(label) AS label FROM (SELECT DISTINCT paper_id, location, start_idx, end_idx, 'term' AS label FROM gold) GROUP BY ALL")
def term_only_gold(spark, sf_dir):
    """Gold entities with 'term' for every label."""
    made = records.as_terms(fx.gold(spark, sf_dir)).select(*SPAN, "label").distinct()
    return made.groupBy("paper_id", "location").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("label"))


def tok_sql(pattern: str) -> str:
    return f", t AS ({tokenised('sections', pattern)}) SELECT paper_id, location, count(*) AS n, CAST(sum(s) AS BIGINT) AS starts, max(e) AS size, CAST(sum(CASE WHEN regexp_matches(tok, '\\S') THEN 1 ELSE 0 END) AS BIGINT) AS solid FROM t GROUP BY ALL"


def tok(spark, sf_dir, pattern):
    made = segment.tokenise(read(spark, sf_dir), pattern)
    return made.groupBy("paper_id", "location").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s").cast("long")).alias("starts"), F.max("e").alias("size"), F.count_if(F.col("tok").rlike(r"\S")).alias("solid"))


@query(tok_sql(segment.WHITESPACE))
def tok_ws(spark, sf_dir):
    return tok(spark, sf_dir, segment.WHITESPACE)


@query(tok_sql(segment.GLINER))
def tok_gliner(spark, sf_dir):
    return tok(spark, sf_dir, segment.GLINER)


@query(tok_sql(fx.WORDPUNCT))
def tok_wordpunct(spark, sf_dir):
    return tok(spark, sf_dir, fx.WORDPUNCT)


WORDS = f", ws AS (SELECT paper_id, location, row_number() OVER (PARTITION BY paper_id, location ORDER BY i) AS i, s, e FROM ({tokenised('sections', segment.WHITESPACE)}) WHERE regexp_matches(tok, '\\S')), grams AS (SELECT a.paper_id, a.location, a.s AS start_idx, b.e - 1 AS end_idx, b.i - a.i + 1 AS n FROM ws a JOIN ws b ON a.paper_id = b.paper_id AND a.location = b.location AND b.i BETWEEN a.i AND a.i + 3)"


def grams(spark, sf_dir):
    return segment.ngrams(segment.solid(segment.tokenise(texts(spark, sf_dir), segment.WHITESPACE)), 4)


@query(WORDS + " SELECT paper_id, location, CAST(n AS BIGINT) AS n, count(*) AS held, CAST(sum(end_idx - start_idx + 1) AS BIGINT) AS chars FROM grams GROUP BY ALL")
def word_ngrams(spark, sf_dir):
    return grams(spark, sf_dir).groupBy("paper_id", "location", "n").agg(F.count(F.lit(1)).alias("held"), F.sum((F.col("end_idx") - F.col("start_idx") + 1).cast("long")).alias("chars"))


GRAM = hashed("'w|'||paper_id||'|'||location||'|'||start_idx||'|'||end_idx")


@query(WORDS + f", ok AS (SELECT g.* FROM grams g JOIN sections s USING (paper_id, location) WHERE substr(s.text, g.start_idx + 1, 1) <> '(' AND substr(s.text, g.end_idx + 1, 1) <> ')' AND NOT EXISTS (SELECT 1 FROM gold x WHERE x.paper_id = g.paper_id AND x.location = g.location AND x.start_idx <= g.end_idx AND g.start_idx <= x.end_idx)), room AS (SELECT paper_id, count(*) AS room FROM gold GROUP BY paper_id), k AS (SELECT ok.*, row_number() OVER (PARTITION BY paper_id ORDER BY {GRAM}, location, start_idx, end_idx) AS r FROM ok) SELECT paper_id, location, start_idx, end_idx FROM k JOIN room USING (paper_id) WHERE r <= room")
def negative_spans(spark, sf_dir):
    """As many unannotated spans of up to four words as a paper has entities, in a fixed random order."""
    order = fx.hashed("w|", F.col("paper_id"), "|", F.col("location"), "|", F.col("start_idx"), "|", F.col("end_idx"))
    return segment.negative_spans(grams(spark, sf_dir), fx.gold(spark, sf_dir), order).select("paper_id", "location", "start_idx", "end_idx")


def bio_sql(tag: str) -> str:
    return f", hit AS (SELECT t.paper_id, t.location, t.i, arg_max({tag}, n.ord) AS tag FROM tokens t JOIN gold n ON t.paper_id = n.paper_id AND t.location = n.location AND t.s >= n.start_idx AND t.e - 1 <= n.end_idx GROUP BY ALL), tagged AS (SELECT t.*, coalesce(h.tag, 'O') AS tag FROM tokens t LEFT JOIN hit h USING (paper_id, location, i))"


B = "CASE WHEN t.s = n.start_idx THEN 'B' ELSE 'I' END"


@query(bio_sql(B) + " SELECT paper_id, location, tag, count(*) AS n, CAST(sum(i) AS BIGINT) AS places FROM tagged GROUP BY ALL")
def bio_tags(spark, sf_dir):
    made = spans.bio_tags(fx.tokens(spark, sf_dir), fx.gold(spark, sf_dir))
    return made.groupBy("paper_id", "location", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("i").cast("long")).alias("places"))


@query(bio_sql(B + "||'-'||n.label") + " SELECT paper_id, location, tag, count(*) AS n, CAST(sum(i) AS BIGINT) AS places FROM tagged GROUP BY ALL")
def bio_tags_typed(spark, sf_dir):
    made = spans.bio_tags(fx.tokens(spark, sf_dir), fx.gold(spark, sf_dir), typed=True)
    return made.groupBy("paper_id", "location", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("i").cast("long")).alias("places"))


def merge_sql(tag: str, more: str, label: str) -> str:
    return bio_sql(tag) + f", solid AS (SELECT *, substr(tag, 1, 1) AS prefix, substr(tag, 3) AS label, lag(i) OVER w IS NULL AS first, lag(substr(tag, 3)) OVER w AS before FROM tagged WHERE tag <> 'O' WINDOW w AS (PARTITION BY paper_id, location ORDER BY i)), isl AS (SELECT *, sum(CASE WHEN prefix = 'B' OR first{more} THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id, location ORDER BY i) AS k FROM solid) SELECT paper_id, location, min(s) AS start_idx, arg_max(e, i) - 1 AS end_idx{label} FROM isl GROUP BY paper_id, location, k"


@query(merge_sql(B, "", ""))
def bio_merge(spark, sf_dir):
    """Spans of tags without labels; I extends over any gap."""
    tagged = spans.bio_tags(fx.tokens(spark, sf_dir), fx.gold(spark, sf_dir)).withColumn("score", F.lit(1.0))
    return spans.merged_tags(tagged).select("paper_id", "location", "start_idx", "end_idx")


@query(merge_sql(B + "||'-'||n.label", " OR before <> label", ", arg_min(label, i) AS label"))
def bio_merge_typed(spark, sf_dir):
    tagged = spans.bio_tags(fx.tokens(spark, sf_dir), fx.gold(spark, sf_dir), typed=True).withColumn("score", F.lit(1.0))
    return spans.merged_tags(tagged, typed=True).select("paper_id", "location", "start_idx", "end_idx", "label")


GLI = f", gt AS (SELECT *, row_number() OVER (PARTITION BY paper_id, location ORDER BY s) - 1 AS k FROM ({tokenised('sections', segment.GLINER)}) WHERE regexp_matches(tok, '\\S'))"


@query(GLI + " SELECT g.paper_id, g.location, g.start_idx, g.ord, lower(g.label) AS label, min(k) AS first_tok, max(k) AS last_tok FROM gt t JOIN gold g ON t.paper_id = g.paper_id AND t.location = g.location AND t.s <= g.end_idx AND t.e - 1 >= g.start_idx GROUP BY ALL")
def gliner_samples(spark, sf_dir):
    """First and last word of each entity, labels in lower case."""
    words = segment.solid(segment.tokenise(texts(spark, sf_dir), segment.GLINER))
    return segment.covered_tokens(words, fx.gold(spark, sf_dir)).select("paper_id", "location", "start_idx", "ord", F.lower("label").alias("label"), "first_tok", "last_tok")


@query(GLI + ", n AS (SELECT g.paper_id, g.location, g.label, min(k) AS a, max(k) AS b FROM gt t JOIN gold g ON t.paper_id = g.paper_id AND t.location = g.location AND t.s <= g.end_idx AND t.e - 1 >= g.start_idx GROUP BY g.paper_id, g.location, g.start_idx, g.ord, g.label) SELECT paper_id, location, label, CAST(sum(b - a + 1) AS BIGINT) AS n_tokens FROM n GROUP BY ALL")
def gliner_token_level(spark, sf_dir):
    """One row a token of each entity, counted by label."""
    words = segment.solid(segment.tokenise(texts(spark, sf_dir), segment.GLINER))
    each = records.entity_tokens(segment.covered_tokens(words, fx.gold(spark, sf_dir)))
    return each.groupBy("paper_id", "location", "label").agg(F.count(F.lit(1)).alias("n_tokens"))


# --- document records

DOC = f""", big AS (SELECT * FROM gold WHERE paper_id IN (SELECT paper_id FROM gold GROUP BY paper_id HAVING count(*) >= 5)), bounds AS (SELECT paper_id, location, start_idx AS c FROM big UNION SELECT paper_id, location, end_idx + 1 FROM big),
points AS (SELECT paper_id, location, s AS first, tok, s AS p FROM tokens WHERE regexp_matches(tok, '\\S') UNION SELECT t.paper_id, t.location, t.s, t.tok, b.c FROM tokens t JOIN bounds b ON t.paper_id = b.paper_id AND t.location = b.location AND b.c > t.s AND b.c < t.e WHERE regexp_matches(tok, '\\S')),
parts0 AS (SELECT paper_id, location, p AS s, coalesce(lead(p) OVER (PARTITION BY paper_id, location, first ORDER BY p), first + length(tok)) AS e, first, tok FROM points), parts AS (SELECT paper_id, location, s, e, substr(tok, s - first + 1, e - s) AS tok FROM parts0),
sent0 AS ({tokenised('sections', docred.SENTENCE)}), cut AS (SELECT DISTINCT q.paper_id, q.location, q.i FROM sent0 q JOIN big x ON q.paper_id = x.paper_id AND q.location = x.location AND x.start_idx < q.e AND x.end_idx >= q.e),
sent1 AS (SELECT q.*, CASE WHEN lag(c.i) OVER (PARTITION BY q.paper_id, q.location ORDER BY q.i) IS NOT NULL THEN 0 ELSE 1 END AS b FROM sent0 q LEFT JOIN cut c USING (paper_id, location, i)),
sent2 AS (SELECT *, sum(b) OVER (PARTITION BY paper_id, location ORDER BY i) - 1 AS sent_id FROM sent1), sents AS (SELECT paper_id, location, CAST(sent_id AS BIGINT) AS sent_id, min(s) AS s, max(e) AS e FROM sent2 GROUP BY ALL),
st AS (SELECT p.*, q.sent_id, row_number() OVER (PARTITION BY p.paper_id, p.location, q.sent_id ORDER BY p.s) - 1 AS pos FROM parts p JOIN sents q ON p.paper_id = q.paper_id AND p.location = q.location AND p.s >= q.s AND p.e <= q.e)"""


def document_records(spark, sf_dir):
    big = docred.with_enough_entities(fx.gold(spark, sf_dir))
    parts = docred.split_tokens(fx.tokens(spark, sf_dir), big)
    sents = docred.merged_sentences(segment.tokenise(texts(spark, sf_dir), docred.SENTENCE), big)
    return big, parts, sents, docred.sentence_tokens(parts, sents)


@query(DOC + " SELECT paper_id, location, s, e, tok FROM parts")
def docred_tokens(spark, sf_dir):
    """Tokens, cut at entity boundaries."""
    return document_records(spark, sf_dir)[1]


@query(DOC + " SELECT * FROM sents")
def docred_sentences(spark, sf_dir):
    """Sentences, merged where an entity crosses an end."""
    return document_records(spark, sf_dir)[2]


@query(DOC + " SELECT x.paper_id, x.location, x.ord, a.sent_id, a.pos AS first, b.pos + 1 AS end FROM big x JOIN st a ON a.paper_id = x.paper_id AND a.location = x.location AND a.s = x.start_idx JOIN st b ON b.paper_id = x.paper_id AND b.location = x.location AND b.e = x.end_idx + 1 AND a.sent_id = b.sent_id")
def docred_entities(spark, sf_dir):
    """Places of entities in their sentences."""
    lists = docred.enough_lists(fx.gold_lists(spark, sf_dir))
    return docred.placed_lists(texts(spark, sf_dir).join(lists, ["paper_id", "location"]))


@query()
def docred_nested(spark, sf_dir):
    """Whole records: title, sents, vertexSet."""
    lists = docred.enough_lists(fx.gold_lists(spark, sf_dir))
    return docred.nested_lists(texts(spark, sf_dir).join(lists, ["paper_id", "location"], "left"))


# --- learnt sentences

CORE = f"regexp_replace(regexp_replace(tok, {quoted(sentences.OPENING)}, ''), {quoted(sentences.CLOSING)}, '')"


def likelihood_sql(hits: str, rows: str, p: str) -> str:
    return f"(CASE WHEN {hits} = 0 THEN 0 ELSE {hits} * ln({p}) END + CASE WHEN {hits} = {rows} THEN 0 ELSE ({rows} - {hits}) * ln(1 - {p}) END)"


def ratio_sql(both: str, first: str, second: str) -> str:
    rest, other, p = f"({second} - {both})", f"(total - {first})", f"({second} / total)"
    return f"CASE WHEN {both} * total > {first} * {second} THEN -2 * ({likelihood_sql(both, first, p)} + {likelihood_sql(rest, other, p)} - {likelihood_sql(both, first, f'({both} / {first})')} - {likelihood_sql(rest, other, f'({rest} / {other})')}) ELSE 0 END"


LETTERS = "length(replace(type, '.', ''))"
LEARNT = f""", w0 AS (SELECT paper_id, location, s, e, {CORE} AS core FROM ({tokenised('sections', segment.WHITESPACE)}) WHERE regexp_matches(tok, '\\S')),
w1 AS (SELECT *, regexp_matches(core, '[^.]\\.$') AS period, regexp_matches(core, '[!?]$') AS stop, regexp_matches(core, '^\\p{{Lu}}') AS upper_, regexp_matches(core, '^\\p{{Ll}}') AS lower_ FROM w0),
w2 AS (SELECT *, regexp_replace(lower(CASE WHEN period THEN left(core, length(core) - 1) ELSE core END), '^\\d+([.,]\\d+)*$', '#') AS type FROM w1),
wt AS (SELECT *, lead(type) OVER o AS after_type, lead(upper_) OVER o AS after_upper, lead(s) OVER o AS after_s, lag(NOT (period OR stop)) OVER o AS middle FROM w2 WINDOW o AS (PARTITION BY paper_id, location ORDER BY s)),
tot AS (SELECT count(*) AS total, count(*) FILTER (period) AS periods FROM wt),
ab0 AS (SELECT type, count(*) FILTER (period) AS n_with, count(*) FILTER (NOT period) AS n_without FROM wt WHERE regexp_matches(type, '\\p{{L}}') GROUP BY type),
ab1 AS (SELECT type, n_with, n_without, -2 * ({likelihood_sql('n_with', '(n_with + n_without)', '(periods / total)')} - {likelihood_sql('n_with', '(n_with + n_without)', str(sentences.CERTAIN))}) * exp(-{LETTERS}) * (length(type) - {LETTERS} + 1) * pow({LETTERS}, -n_without) AS score FROM ab0, tot WHERE n_with > 0),
ab AS (SELECT * FROM ab1 WHERE score >= {sentences.ABBREVIATION}),
kn AS (SELECT wt.*, ab.type AS abbreviation, stop OR (period AND ab.type IS NULL) AS is_end FROM wt LEFT JOIN ab USING (type)),
types AS (SELECT type, count(*) AS n, count(*) FILTER (lower_) AS n_lower, count(*) FILTER (upper_ AND middle) AS n_middle FROM wt GROUP BY type),
tot2 AS (SELECT count(*) AS total, count(*) FILTER (is_end) AS ends FROM kn),
st0 AS (SELECT after_type AS type, count(*) AS hits FROM kn WHERE is_end AND after_type IS NOT NULL AND regexp_matches(after_type, '\\p{{L}}') GROUP BY ALL),
starters AS (SELECT * FROM (SELECT type, hits, n, {ratio_sql('hits', 'ends', 'n')} AS ratio FROM st0 JOIN types USING (type), tot2) WHERE ratio >= {sentences.STARTER}),
pr0 AS (SELECT type, after_type AS next, count(*) AS hits FROM kn WHERE period AND after_type IS NOT NULL AND (abbreviation IS NOT NULL OR regexp_matches(type, '^(#|\\p{{L}})$')) GROUP BY ALL HAVING count(*) > 1),
pairs AS (SELECT type, next, hits, ratio FROM (SELECT p.type, p.next, hits, {ratio_sql('hits', 'a.n', 'b.n')} AS ratio FROM pr0 p JOIN types a ON a.type = p.type JOIN types b ON b.type = p.next, tot2) WHERE ratio >= {sentences.PAIR}),
cut AS (SELECT k.paper_id, k.location, k.after_s AS s FROM kn k LEFT JOIN starters st ON st.type = k.after_type LEFT JOIN pairs p ON p.type = k.type AND p.next = k.after_type LEFT JOIN types t ON t.type = k.after_type AND t.n_lower > 0 AND t.n_middle = 0
 WHERE (k.period OR k.stop) AND k.after_s IS NOT NULL AND (k.stop OR (p.type IS NULL AND (NOT (k.abbreviation IS NOT NULL OR regexp_matches(k.type, '^\\p{{L}}$')) OR (k.after_upper AND (st.type IS NOT NULL OR t.type IS NOT NULL)))))),
began AS (SELECT paper_id, location, 0 AS s FROM sections WHERE text <> '' UNION ALL SELECT * FROM cut),
learnt AS (SELECT b.paper_id, b.location, CAST(b.s AS BIGINT) AS s, CAST(coalesce(lead(b.s) OVER (PARTITION BY b.paper_id, b.location ORDER BY b.s), length(x.text)) AS BIGINT) AS e FROM began b JOIN sections x USING (paper_id, location))"""


def known_sentences(spark, sf_dir):
    return sentences.learnt(read(spark, sf_dir))


@query(LEARNT + " SELECT 'abbreviation' AS kind, type, NULL AS next, n_with AS n, round(score, 6) AS ratio FROM ab UNION ALL SELECT 'starter', type, NULL, hits, round(ratio, 6) FROM starters UNION ALL SELECT 'pair', type, next, hits, round(ratio, 6) FROM pairs")
def sentence_statistics(spark, sf_dir):
    """Abbreviations, sentence starters and pairs that the corpus tells."""
    known = known_sentences(spark, sf_dir)
    none = F.lit(None).cast("string").alias("next")
    rows = known.abbreviations.select(F.lit("abbreviation").alias("kind"), "type", none, F.col("n_with").alias("n"), F.round("score", 6).alias("ratio"))
    rows = rows.unionByName(known.starters.select(F.lit("starter").alias("kind"), "type", none, F.col("hits").alias("n"), F.round("ratio", 6).alias("ratio")))
    return rows.unionByName(known.pairs.select(F.lit("pair").alias("kind"), "type", "next", F.col("hits").alias("n"), F.round("ratio", 6).alias("ratio")))


@query(LEARNT + " SELECT paper_id, location, row_number() OVER (PARTITION BY paper_id, location ORDER BY s) - 1 AS i, s, e FROM learnt")
def sentence_spans(spark, sf_dir):
    """Sentences that these statistics tell apart."""
    return sentences.split(read(spark, sf_dir), known_sentences(spark, sf_dir)).select("paper_id", "location", "i", "s", "e")


# --- fine-tuning

SYSTEM, TEMPLATE = "You are an annotator.", "Annotate {as JSON}: {text}"


def esc(x: str) -> str:
    out = f"replace(replace({x}, '\\', '\\\\'), '\"', '\\\"')"
    for code, to in ((10, "\\n"), (13, "\\r"), (9, "\\t")):
        out = f"replace({out}, chr({code}), '{to}')"
    return f"'\"'||{out}||'\"'"


def list_sql(item: str) -> str:
    return f", f AS (SELECT paper_id, location, {item} AS item, min(ord) AS o FROM gold_text GROUP BY ALL), l AS (SELECT paper_id, location, '['||array_to_string(list(item ORDER BY o, item), ', ')||']' AS a FROM f GROUP BY ALL) SELECT paper_id, location, {quoted(SYSTEM)} AS system, md5(replace({quoted(TEMPLATE)}, '{{text}}', text)) AS user, coalesce(a, '[]') AS assistant FROM sections LEFT JOIN l USING (paper_id, location) WHERE text <> ''"


@query(list_sql(esc("text_span")))
def ft_te(spark, sf_dir):
    made = finetune.listing_examples(texts(spark, sf_dir), fx.with_text(fx.gold(spark, sf_dir), spark, sf_dir), SYSTEM, TEMPLATE)
    return made.withColumn("user", F.md5("user"))


@query(list_sql("'{\"term\": '||" + esc("text_span") + "||', \"label\": '||" + esc("label") + "||'}'"))
def ft_ner(spark, sf_dir):
    made = finetune.listing_examples(texts(spark, sf_dir), fx.with_text(fx.gold(spark, sf_dir), spark, sf_dir), SYSTEM, TEMPLATE, labels=True)
    return made.withColumn("user", F.md5("user"))


@query(f"SELECT paper_id, location, ord, {quoted(SYSTEM)} AS system, md5(replace({quoted(TEMPLATE)}, '{{text}}', substr(text, 1, start_idx)||'[E1]'||substr(text, start_idx + 1, end_idx - start_idx + 1)||'[/E1]'||substr(text, end_idx + 2))) AS user, label AS assistant FROM gold JOIN sections USING (paper_id, location)")
def ft_tc(spark, sf_dir):
    return finetune.label_examples(read(spark, sf_dir), fx.gold(spark, sf_dir, dealt=False), SYSTEM, TEMPLATE, digest=True)


@query(", p AS (SELECT g.*, coalesce(r.predicate, 'NA') AS predicate FROM gated g LEFT JOIN gold_relations r USING (paper_id, location, subject_ord, object_ord)) SELECT paper_id, CASE WHEN predicate = 'NA' THEN 'neg' ELSE 'pos' END||row_number() OVER (PARTITION BY paper_id, predicate = 'NA' ORDER BY location DESC, subject_ord, object_ord) AS id, predicate AS assistant FROM p")
def ft_re(spark, sf_dir):
    """Relation examples; ids count positives and negatives of a paper."""
    keys = ["paper_id", "location", "subject_ord", "object_ord"]
    pairs = relations.with_predicate(relations.valid_pairs(fx.gold(spark, sf_dir), valid_relations(spark)), fx.gold_relations(spark, sf_dir), keys, "predicate")
    return finetune.relation_examples(texts(spark, sf_dir), pairs, SYSTEM, TEMPLATE).select("paper_id", "id", "assistant")


# --- parsers and functions

LINE = "lower(trim(split_part(r, chr(10), 1)))"
LONGEST = sorted(LABELS, key=lambda x: (-len(x), x))
PARSE = "coalesce(" + ", ".join([f"CASE WHEN {LINE} = {quoted(x.lower())} THEN {quoted(x)} END" for x in LABELS] + [f"CASE WHEN contains({LINE}, {quoted(x.lower())}) THEN {quoted(x)} END" for x in LONGEST]) + ", 'NA')"
RESPONSE = "CASE ord % 4 WHEN 0 THEN ' '||upper(label)||chr(10)||'because' WHEN 1 THEN 'The label is '||label||'.' WHEN 2 THEN 'unsure' ELSE label END"


@query(f"SELECT paper_id, ord, {PARSE} AS parsed FROM (SELECT paper_id, ord, {RESPONSE} AS r FROM gold)")
def parse_label_responses(spark, sf_dir):
    """Labels read from made-up model responses."""
    said = fx.gold(spark, sf_dir).withColumn("r", F.expr(RESPONSE.replace("chr(10)", "char(10)")))
    return said.select("paper_id", "ord", parse_label(F.col("r")).alias("parsed"))


@query("SELECT paper_id, ord, trim(split_part(r, sep, 1)) AS term, trim(substr(r, strpos(r, sep) + length(sep))) AS label FROM (SELECT paper_id, ord, word||sep||label AS r, sep FROM (SELECT *, CASE ord % 3 WHEN 0 THEN ' | ' WHEN 1 THEN ': ' ELSE ' - ' END AS sep FROM gold))")
def parse_term_labels(spark, sf_dir):
    """Lines 'term | label', 'term: label' or 'term - label'."""
    sep = F.expr("case ord % 3 when 0 then ' | ' when 1 then ': ' else ' - ' end")
    return fx.gold(spark, sf_dir).select("paper_id", "ord", split_term_label(F.concat("word", sep, "label")).alias("x")).select("paper_id", "ord", "x.term", "x.label")


@query()
def parse_terms(spark, sf_dir):
    """Term lists read from made-up responses in several forms."""
    said = fx.gold(spark, sf_dir).groupBy("paper_id").agg(F.array_sort(F.collect_set("word")).alias("words"))
    form = F.expr("case cast(paper_id as long) % 4 when 0 then concat('[\"', array_join(words, '\", \"'), '\"]') when 1 then concat('- ', array_join(words, '\n- ')) when 2 then array_join(words, ', ') else concat('Terms: ', to_json(words), ' done') end")
    return said.select("paper_id", F.size("words").alias("n_words"), form.alias("response")).transform(providers.parsed_terms).select("paper_id", "n_words", F.size("terms").alias("n_terms"))


FIND = ", w AS (SELECT DISTINCT paper_id, location, word FROM gold), t AS (SELECT w.*, string_split(lower(s.text), word) AS parts FROM w JOIN sections s USING (paper_id, location))"


@query(FIND + " SELECT paper_id, location, word, CAST(len(parts) - 1 AS BIGINT) AS n, CAST(CASE WHEN len(parts) > 1 THEN length(parts[1]) END AS BIGINT) AS first FROM t")
def find_spans(spark, sf_dir):
    """All occurrences of each mention's word in its section, whatever the case."""
    words = fx.gold(spark, sf_dir).select("paper_id", "location", F.col("word").alias("term")).distinct()
    found = anchors.anchored(words, texts(spark, sf_dir))
    return found.groupBy("paper_id", "location", F.col("term").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.min("start_idx").alias("first"))


LOGITS = "CAST(embedding[1:18] AS DOUBLE[])"


def logits(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform(F.slice("embedding", 1, 18), lambda x: x.cast("double")).alias("z"))


@query(f"SELECT vec_id, round(list_max(p), 6) AS confscore, CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS label FROM (SELECT vec_id, list_transform(l, lambda x: exp(x) / list_sum(list_transform(l, lambda y: exp(y)))) AS p FROM (SELECT vec_id, {LOGITS} AS l FROM embeddings))", bare=True)
def softmax_conf(spark, sf_dir):
    p = logits(spark, sf_dir).select("vec_id", scores.softmax(F.col("z")).alias("p"))
    return p.select("vec_id", F.round(F.array_max("p"), 6).alias("confscore"), scores.argmax(F.col("p")).alias("label"))


ALLOWED = "[" + ", ".join("true" if k == 0 or k % 3 == 1 else "false" for k in range(18)) + "]"


@query(f"SELECT vec_id, CAST(list_position(m, list_max(m)) - 1 AS BIGINT) AS label, (['NA', {', '.join(map(quoted, PREDICATES))}])[CAST(list_position(m, list_max(m)) AS INT)] AS predicate FROM (SELECT vec_id, list_transform(l, lambda x, i: CASE WHEN ({ALLOWED})[i] THEN x ELSE -1e300 END) AS m FROM (SELECT vec_id, {LOGITS} AS l FROM embeddings))", bare=True)
def type_mask_argmax(spark, sf_dir):
    """The best predicate among those that a pair's labels allow, and NA."""
    allowed = F.array(*[F.lit(k == 0 or k % 3 == 1) for k in range(18)])
    best = logits(spark, sf_dir).select("vec_id", scores.argmax(scores.masked(F.col("z"), allowed)).alias("label"))
    return best.withColumn("predicate", F.element_at(F.array(*map(F.lit, ["NA", *PREDICATES])), F.col("label") + 1))


@query(f"SELECT vec_id, CAST(len(d) AS BIGINT) AS n, array_to_string(CASE WHEN len(d) > 0 THEN d ELSE [0] END, ',') AS labels FROM (SELECT vec_id, list_filter(range(1, 18), lambda k: l[k + 1] > l[1]) AS d FROM (SELECT vec_id, {LOGITS} AS l FROM embeddings))", bare=True)
def atloss_decode(spark, sf_dir):
    """Labels whose logit is above that of the first, which is the threshold."""
    found = logits(spark, sf_dir).select("vec_id", scores.adaptive_labels(F.col("z")).alias("d"))
    return found.select("vec_id", F.when(F.col("d")[0] == 0, 0).otherwise(F.size("d")).alias("n"), F.array_join(F.transform("d", lambda x: x.cast("string")), ",").alias("labels"))


@query("SELECT paper_id, location, start_idx, ord, text_span, substr(text_span, 1, 1) = '(' AS opens, lower(text_span) AS low, replace(text_span, '_', ' ') AS spaced FROM gold_text")
def span_text_rederive(spark, sf_dir):
    """text_span cut from the section, with its normal forms."""
    t = F.col("text_span")
    return fx.with_text(fx.gold(spark, sf_dir), spark, sf_dir).select("paper_id", "location", "start_idx", "ord", t, F.startswith(t, F.lit("(")).alias("opens"), F.lower(t).alias("low"), F.replace(t, F.lit("_"), F.lit(" ")).alias("spaced"))


BROKEN = "SELECT paper_id, CASE WHEN ord % 17 = 0 THEN 'body' ELSE location END AS location, CASE WHEN ord % 13 = 0 THEN -1 ELSE start_idx END AS start_idx, CASE WHEN ord % 11 = 0 THEN 99999 ELSE end_idx END AS end_idx, ord FROM {gold}"


@query(", b AS (" + BROKEN.format(gold="gold") + ") SELECT b.paper_id, b.location, b.ord, CASE WHEN b.location NOT IN ('title', 'abstract') THEN 'location' WHEN start_idx < 0 THEN 'start' WHEN end_idx >= length(text) THEN 'end' END AS reason FROM b LEFT JOIN sections USING (paper_id, location) WHERE b.location NOT IN ('title', 'abstract') OR start_idx < 0 OR end_idx >= length(text)")
def bad_offsets(spark, sf_dir):
    """Entities set aside because of their offsets or location, with the reason."""
    broken = fx.gold(spark, sf_dir).selectExpr("paper_id", "case when ord % 17 = 0 then 'body' else location end as location", "case when ord % 13 = 0 then -1 else start_idx end as start_idx", "case when ord % 11 = 0 then 99999 else end_idx end as end_idx", "ord")
    return spans.out_of_bounds(broken, texts(spark, sf_dir)).select("paper_id", "location", "ord", "reason")


@query("SELECT paper_id, CASE WHEN CAST(paper_id AS BIGINT) % 3 = 0 THEN 'stored' ELSE 'new' END AS origin, count(*) AS n FROM pred WHERE m = 0 GROUP BY ALL")
def resume_antijoin(spark, sf_dir):
    """Stored papers are kept, only the others are processed."""
    own = fx.pred(spark, sf_dir).filter("m = 0").groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    stored = own.filter("cast(paper_id as long) % 3 = 0").withColumn("origin", F.lit("stored"))
    return resume.resumed(own, stored, lambda df: df.withColumn("origin", F.lit("new"))).select("paper_id", "origin", "n")


@query("SELECT name, micro_f1, n FROM (SELECT 'm'||m AS name, round(avg(confscore), 6) AS micro_f1, count(*) AS n FROM pred GROUP BY m UNION ALL SELECT 'dedup'||m, round(avg(confscore), 6), count(*) FROM dedup GROUP BY m)")
def metrics_csv_merge(spark, sf_dir):
    """Two score tables, one below the other."""
    from annolake.sources.files import merged_tables

    sums = lambda df, p: df.groupBy("m").agg(F.round(F.avg("confscore"), 6).alias("micro_f1"), F.count(F.lit(1)).alias("n")).select(F.concat(F.lit(p), F.col("m")).alias("name"), "micro_f1", "n")
    predicted = fx.pred(spark, sf_dir)
    return merged_tables([sums(predicted, "m"), sums(spans.deduplicated(predicted, "m"), "dedup")], "micro_f1", ascending=False)


STUB = hashed("'t|'||lower(tok)")


@query(f"SELECT paper_id, location, s AS start_idx, e - 1 AS end_idx, {STUB} % 1000 / 1000 AS confscore FROM tokens WHERE regexp_full_match(tok, '[\\p{{L}}\\p{{N}}_]+') AND length(tok) >= 4 AND {STUB} % 7 = 0")
def stub_te(spark, sf_dir):
    """Term extraction with a stand-in model that tags words by their md5."""
    return providers.extract_terms(read(spark, sf_dir), providers.HashTagger()).select("paper_id", "location", "start_idx", "end_idx", "confscore")


@query(f"SELECT paper_id, location, s AS start_idx, e - 1 AS end_idx, ({LABEL_LIST})[CAST({STUB} % 13 + 1 AS INT)] AS label FROM tokens WHERE regexp_full_match(tok, '[\\p{{L}}\\p{{N}}_]+') AND length(tok) >= 4 AND {STUB} % 7 = 0")
def stub_ner(spark, sf_dir):
    """Joint extraction and classification with the same stand-in."""
    return providers.extract_entities(read(spark, sf_dir), providers.HashTagger()).select("paper_id", "location", "start_idx", "end_idx", "label")


SEEN = "substr(text, 1, start_idx)||'[E1]'||substr(text, start_idx + 1, end_idx - start_idx + 1)||'[/E1]'||substr(text, end_idx + 2)"


@query(f"SELECT paper_id, location, start_idx, ord, ({LABEL_LIST})[CAST(h % 13 + 1 AS INT)] AS label, (h % 1000) / 1000 AS confscore FROM (SELECT g.*, {hashed(SEEN)} AS h FROM gold g JOIN sections USING (paper_id, location))")
def stub_tc(spark, sf_dir):
    """Term classification with a stand-in model over marked texts."""
    return providers.classify_terms(fx.gold(spark, sf_dir, dealt=False).drop("uri", "word"), read(spark, sf_dir), providers.HashClassifier(LABELS)).select("paper_id", "location", "start_idx", "ord", "label", "confscore")


RE_WINDOW = 200


def around_sql(first: str, second: str, x: str, y: str) -> str:
    gap = f"{second}.start_idx - {first}.end_idx - 1"
    between = f"CASE WHEN {gap} <= {2 * RE_WINDOW} THEN substr({first}.after_, 1, {gap}) ELSE substr({first}.after_, 1, {RE_WINDOW})||' … '||{second}.before_ END"
    return f"{first}.before_||'[{x}]'||{first}.span_||'[/{x}]'||{between}||'[{y}]'||{second}.span_||'[/{y}]'||substr({second}.after_, 1, {RE_WINDOW})"


RE = f""", ctx AS (SELECT g.*, substr(text, greatest(start_idx - {RE_WINDOW}, 0) + 1, start_idx - greatest(start_idx - {RE_WINDOW}, 0)) AS before_, substr(text, start_idx + 1, end_idx - start_idx + 1) AS span_, substr(text, end_idx + 2, {2 * RE_WINDOW}) AS after_ FROM gold g JOIN sections USING (paper_id, location)),
seen AS (SELECT a.paper_id, a.location, a.start_idx AS subject_start_idx, b.start_idx AS object_start_idx, list_append(v.predicates, 'NA') AS choices, CASE WHEN a.start_idx < b.start_idx THEN {around_sql('a', 'b', 'E1', 'E2')} ELSE {around_sql('b', 'a', 'E2', 'E1')} END AS text
 FROM ctx a JOIN ctx b ON a.paper_id = b.paper_id AND a.location = b.location AND a.ord <> b.ord JOIN valid v ON a.label = v.head AND b.label = v.tail WHERE a.end_idx + 1 <= b.start_idx OR b.end_idx + 1 <= a.start_idx),
told AS (SELECT *, {hashed('text')} AS h FROM seen)
SELECT paper_id, location, subject_start_idx, object_start_idx, choices[CAST(h % len(choices) + 1 AS INT)] AS predicate, (h % 1000) / 1000 AS confscore FROM told WHERE choices[CAST(h % len(choices) + 1 AS INT)] <> 'NA'"""


@query(RE)
def stub_re(spark, sf_dir):
    """Relation extraction with a stand-in model, among the predicates that labels allow, from the text around both ends."""
    sections = texts(spark, sf_dir).join(fx.gold_lists(spark, sf_dir), ["paper_id", "location"])
    rules = [(head, tail, sorted(predicates)) for head, tail, predicates in VALID_RELATIONS]
    return providers.pair_relations(sections, rules, providers.HashClassifier(PREDICATES), RE_WINDOW)
