"""One query per operator, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import audio, decontaminate, jaccard, language, mixing, passages, private_data, quality_cnn, suffixes, toxicity
from pagemill.llm import spelling, turns, word_bpe
from pagemill.llm.labelled import fold
from pagemill.sources.tables import read_table


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    found = language.predict(docs, language.train(docs, fold(4) != 2))
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op3_audio_features(spark: SparkSession, folder: str) -> DataFrame:
    return audio.digest(audio.features(audio.store(read_table(spark, folder, "documents"))))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    net = toxicity.train(docs, labels, "toxic", fold(4) != 2)
    scored = toxicity.score(docs, net)
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", "predicted")


def op5_private_data(spark: SparkSession, folder: str) -> DataFrame:
    return private_data.digest(private_data.find(read_table(spark, folder, "documents")))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeated_bytes(read_table(spark, folder, "documents"))


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_texts(read_table(spark, folder, "documents"))


def op9_passage_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passages.remove_repeated_passages(read_table(spark, folder, "documents"))


def op10_quality_cnn(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    net = quality_cnn.train(docs, labels, "quality", fold(5) != 0)
    scored = quality_cnn.score(docs, net)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(read_table(spark, folder, "documents"))


def op12_repair_turns(spark: SparkSession, folder: str) -> DataFrame:
    conversations = read_table(spark, folder, "conversations")
    return turns.digest(conversations, turns.repair(turns.damage(conversations)))


def op13_word_bpe(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return word_bpe.digest(word_bpe.decode(word_bpe.encode(read_table(spark, folder, "documents"), vocabulary), vocabulary))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_language": op2_language,
    "op3_audio_features": op3_audio_features,
    "op4_toxicity": op4_toxicity,
    "op5_private_data": op5_private_data,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_passage_dedup": op9_passage_dedup,
    "op10_quality_cnn": op10_quality_cnn,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_repair_turns": op12_repair_turns,
    "op13_word_bpe": op13_word_bpe,
}

# Words are counted by the rule of the operators; the rest follows the text of the contract.
ORACLE: dict[str, str] = {
    "op11_spelling_variants": r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
run AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
each AS (
  SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS bytes
  FROM run WHERE length(run) >= 5 GROUP BY doc_id, run),
checked AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, [CAST('0x' || bytes[k:k + 1] AS BIGINT) FOR k IN range(1, length(bytes), 2)]),
         lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS h
  FROM each, crc),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM checked) x
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (
  SELECT word, n, k, left(word, k) || substr(word, k + 2) AS rest FROM words, LATERAL (SELECT unnest(range(length(word))) AS k) x),
near AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, min({'m': -n, 'w': other}) AS best FROM near GROUP BY word),
form AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * w.n THEN best.w END AS form, CASE WHEN -best.m >= 2 * w.n THEN -best.m END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
follow AS (
  SELECT word, word AS at FROM form
  UNION ALL SELECT f.word, g.form FROM follow f JOIN form g ON g.word = f.at WHERE g.form IS NOT NULL)
SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n
FROM form f JOIN (SELECT x.word, x.at FROM follow x JOIN form y ON y.word = x.at WHERE y.form IS NULL) r ON r.word = f.word""",
    "op12_repair_turns": r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
hit AS (
  SELECT keyed.*, xor(list_reduce(list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(k, '')]),
         lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS kind
  FROM keyed, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, range(2) copy(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
judged AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM numbered),
state AS (SELECT unnest(['', 's', 'u', 'a']) AS q),
step AS (
  SELECT q AS came, initial, CASE WHEN q = '' AND initial = 's' THEN 's' WHEN q <> 'u' AND initial = 'u' THEN 'u'
         WHEN q = 'u' AND initial = 'a' THEN 'a' END AS goes
  FROM state, (SELECT DISTINCT initial FROM judged) x),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '' AS q, CAST(0 AS BIGINT) AS cost, '' AS audit FROM (SELECT DISTINCT conv_id FROM conversations) x
  UNION ALL
  SELECT conv_id, i, q, best.c, best.a
  FROM (
    SELECT conv_id, i, q, min({'c': cost, 'a': audit}) AS best
    FROM (
      SELECT g.conv_id, j.i, e.q, g.cost + e.more AS cost, g.audit || e.letter AS audit
      FROM (
        SELECT conv_id, i, q, cost, audit FROM dp
        UNION ALL
        SELECT conv_id, i, CASE WHEN q = 'u' THEN 'a' ELSE 'u' END, cost + 5, audit || 'I' FROM dp) g
      JOIN judged j ON j.conv_id IS NOT DISTINCT FROM g.conv_id AND j.i = g.i + 1,
      LATERAL (
        SELECT g.q AS q, 2 AS more, 'D' AS letter
        UNION ALL
        SELECT s.goes, CASE WHEN j.fault = 'truncated' THEN 5 ELSE 0 END, 'K' FROM step s
        WHERE s.came = g.q AND s.initial = j.initial AND s.goes IS NOT NULL AND j.fault NOT IN ('blank', 'duplicate')
        UNION ALL
        SELECT CASE WHEN g.q = 'u' THEN 'a' ELSE 'u' END, CASE WHEN j.fault = 'truncated' THEN 6 ELSE 1 END, 'R'
        WHERE j.fault NOT IN ('blank', 'duplicate')) e) offers
    GROUP BY conv_id, i, q) x),
ended AS (
  SELECT dp.conv_id, min({'c': cost + e.more, 'a': audit || e.letter}) AS best
  FROM dp LEFT JOIN (SELECT conv_id, max(i) AS n FROM judged GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM dp.conv_id,
  LATERAL (SELECT 0 AS more, '' AS letter WHERE q IN ('', 'a') UNION ALL SELECT 5, 'I' WHERE q = 'u') e
  WHERE dp.i = coalesce(m.n, 0) GROUP BY dp.conv_id),
letter AS (
  SELECT conv_id, k, best.a[k] AS letter FROM ended, LATERAL (SELECT unnest(range(1, length(best.a) + 1)) AS k) x),
placed AS (
  SELECT conv_id, k, letter, count(*) FILTER (WHERE letter <> 'I') OVER w AS i, count(*) FILTER (WHERE letter <> 'D') OVER w AS o
  FROM letter WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
written AS (
  SELECT p.conv_id, p.k, p.letter, p.o, j.role, j.text, max(CASE WHEN p.o = 1 AND p.letter = 'K' AND j.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS s
  FROM placed p LEFT JOIN judged j ON p.letter <> 'I' AND j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i
  WHERE p.letter <> 'D'),
mended AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END
         || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS lines
  FROM written GROUP BY conv_id),
measured AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(e.best.c AS BIGINT) AS cost, e.best.a AS audit,
       sha256(coalesce(lines, '')) AS repaired_sha256
FROM ended e LEFT JOIN measured m ON m.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN mended d ON d.conv_id IS NOT DISTINCT FROM e.conv_id""",
    "op8_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS shingles
  FROM w),
x AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
  FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common WHERE 100 * i >= 75 * (na + nb - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = s.doc_id""",
    "op1_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS draw,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget FROM s),
v AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM f),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM v),
p AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM p)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN upto - size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c""",
}
