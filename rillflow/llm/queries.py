"""The registered queries of this subpackage, thin over the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import (
    collocations,
    embedding_dedup,
    fingerprints,
    language,
    licenses,
    packing,
    pii,
    repetition,
    sentencepieces,
    simhash,
    suffix_dedup,
    token_rollup,
    whitening,
)
from rillflow.llm.common import documents, staged
from rillflow.session import scratch_dir

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of 50 words or more that occurs more than once, in whole documents."""
    return suffix_dedup.repeated_passages(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose fingerprints are linked."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids packed into windows."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings."""
    return embedding_dedup.near_duplicates(documents(spark, sf_dir, "embeddings"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint against those of its edited text and of the next document."""
    return fingerprints.compare_edits(documents(spark, sf_dir))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of all documents."""
    return licenses.scan(documents(spark, sf_dir))


def op7_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, there and back."""
    return sentencepieces.digests(documents(spark, sf_dir), public_tokenizers.path(PIECE_BPE))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those not held out."""
    docs = documents(spark, sf_dir)
    return language.identify(docs, language.learn(docs))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.digests(pii.find(documents(spark, sf_dir)))


OLD, NEW = "byte_bpe_50k", "byte_bpe_multi_50k"


def token_batches(counts: DataFrame) -> list[DataFrame]:
    """Three batches over ``count_tokens``: all documents come in under the old tokenizer; those
    not in English are counted anew under the new one; every seventh id is deleted again, under
    the tokenizer it stands under by then."""
    old, new = F.col(f"tokens_{OLD}"), F.col(f"tokens_{NEW}")
    moved = counts.where(~F.col("lang").eqNullSafe("en"))
    gone = counts.where(F.col("doc_id") % 7 == 0)
    english = F.col("lang").eqNullSafe("en")
    name = F.when(english, F.lit(OLD)).otherwise(F.lit(NEW))
    return [
        token_rollup.change(counts, F.lit(OLD), old, 1),
        token_rollup.change(moved, F.lit(OLD), old, -1).union(
            token_rollup.change(moved, F.lit(NEW), new, 1)
        ),
        token_rollup.change(gone, name, F.when(english, old).otherwise(new), -1),
    ]


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after inserts, revisions, deletes, a repeated commit and a compaction."""
    paths = {v: public_tokenizers.path(f"{v}.tiktoken") for v in (OLD, NEW)}
    docs = documents(spark, sf_dir)
    counts = token_rollup.count_tokens(docs, paths, public_tokenizers.PATTERN)
    batches = token_batches(staged(counts, "token-counts"))
    ledger = token_rollup.Ledger(spark, scratch_dir(spark, "token-ledger"))
    for batch_id, deltas in enumerate(batches[:2]):
        ledger.commit(batch_id, deltas)
    ledger.compact()
    ledger.commit(1, batches[1])
    for _ in range(2):
        ledger.commit(2, batches[2])
    return ledger.totals()


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of two to four words of every language."""
    return collocations.collocations(documents(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings projected on the leading components of their covariance."""
    return whitening.whiten(documents(spark, sf_dir, "embeddings"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of all documents."""
    return repetition.judge(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_fingerprints": op5_fingerprints,
    "op6_licenses": op6_licenses,
    "op7_sentencepieces": op7_sentencepieces,
    "op8_language": op8_language,
    "op9_pii": op9_pii,
    "op10_token_rollup": op10_token_rollup,
    "op11_collocations": op11_collocations,
    "op12_whitening": op12_whitening,
    "op13_quality": op13_quality,
}

# Windows of 50 words that occur at two places or more, as unions of neighbouring ones.
OP1 = r"""
with words as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x09-\x0D\x20]+'), lambda x: x <> '') as w
  from documents
  where text is not null
),
starts as (
  select doc_id, w, unnest(range(len(w) - 49)) as s from words where len(w) >= 50
),
windows as (
  select doc_id, s, md5(array_to_string(w[s + 1 : s + 50], ' ')) as h from starts
),
repeated as (
  select doc_id, s from (select doc_id, s, count(*) over (partition by h) as n from windows)
  where n > 1
),
marked as (
  select doc_id, s,
         case when s <= max(s) over (partition by doc_id order by s rows between unbounded
                                     preceding and 1 preceding) + 50 then 0 else 1 end as fresh
  from repeated
),
islands as (
  select doc_id, s, sum(fresh) over (partition by doc_id order by s rows unbounded preceding) as i
  from marked
)
select doc_id, min(s) as start_word, max(s) + 50 as end_word, max(s) + 50 - min(s) as n_words
from islands
group by doc_id, i
"""

# All pairs of vectors; rows are numbered, so that repeated ids stay rows of their own.
OP4 = """
with recursive
rows as (
  select vec_id, row_number() over () as r, list_transform(embedding, lambda x: x::double) as v
  from embeddings
),
sized as (
  select r, vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as size
  from rows
  where v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0
),
units as (select r, vec_id, list_transform(v, lambda x: x / size) as u from sized where size > 0),
links as (
  select a.r as a, b.r as b
  from units a join units b on a.r <> b.r and len(a.u) = len(b.u)
  where list_dot_product(a.u, b.u) >= 0.95
),
reach as (
  select r as a, r as b from rows
  union
  select reach.a, links.b from reach join links on reach.b = links.a
),
least as (select a, min(vec_id) as component_id from reach join rows on rows.r = reach.b group by a),
counts as (select a, count(*) as n from links group by a)
select rows.vec_id, coalesce(counts.n, 0)::bigint as n_links, least.component_id,
       rows.vec_id is not distinct from least.component_id as kept
from rows join least on least.a = rows.r left join counts on counts.a = rows.r
"""

# Every phrase of one to four words within a piece is written out and counted.
OP11 = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) as piece
  from documents
),
worded as (
  select lang, row_number() over () as piece,
         list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w
  from pieces
),
sizes as (select lang, sum(len(w))::bigint as n from worded group by lang),
tokens as (
  select lang, piece, unnest(w) as word, generate_subscripts(w, 1) as place from worded
),
starts as (
  select lang, word as w1, lead(word, 1) over piece as w2, lead(word, 2) over piece as w3,
         lead(word, 3) over piece as w4
  from tokens window piece as (partition by piece order by place)
),
grams as (
  select lang, 1 as size, w1 as phrase from starts
  union all select lang, 2, concat_ws(' ', w1, w2) from starts where w2 is not null
  union all select lang, 3, concat_ws(' ', w1, w2, w3) from starts where w3 is not null
  union all select lang, 4, concat_ws(' ', w1, w2, w3, w4) from starts where w4 is not null
),
counts as (
  select lang, size, phrase, count(*)::hugeint as f from grams group by all having count(*) >= 30
),
phrases as (select *, string_split(phrase, ' ') as w from counts where size > 1),
cuts as (
  select p.lang, p.phrase, k, one.f as l, two.f as r, (2000000 * p.f) // (one.f + two.f) as score
  from phrases p, range(1, 4) as places(k)
  join counts one on one.lang = p.lang and one.phrase = array_to_string(p.w[1 : k], ' ')
  join counts two on two.lang = p.lang and two.phrase = array_to_string(p.w[k + 1 :], ' ')
  where k < p.size
),
weakest as (
  select * from cuts
  qualify row_number() over (partition by lang, phrase order by score, k) = 1
),
parts as (
  select lang, f, size, s, len, array_to_string(w[s : s + len - 1], ' ') as phrase
  from phrases, range(2, 4) as lengths(len), range(1, 4) as firsts(s)
  where len < size and s + len - 1 <= size
),
held as (
  select lang, phrase, max(f) as held,
         count(*) filter (where len = size - 1 and s = 2) as left_extensions,
         count(*) filter (where len = size - 1 and s = 1) as right_extensions
  from parts group by lang, phrase
),
ranked as (
  select p.lang, p.phrase, p.f as a, l, r, score, left_extensions, right_extensions,
         row_number() over (partition by p.lang order by score desc, p.f desc, p.phrase) as rank
  from phrases p join weakest using (lang, phrase) left join held using (lang, phrase)
  where held is null or 100 * held < 80 * p.f
)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n,
       score::bigint as score, coalesce(left_extensions, 0)::bigint as left_extensions,
       coalesce(right_extensions, 0)::bigint as right_extensions
from ranked join sizes using (lang)
where rank <= 2000
"""

# Every window of each length is written out; its words are marked if it occurs again.
OP13 = r"""
with docs as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
),
lines as (
  select r, line, no, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')
         as w
  from (
    select r, unnest(string_split(text, chr(10))) as line,
           generate_subscripts(string_split(text, chr(10)), 1) as no
    from docs
  )
),
copies as (
  select r, w, row_number() over (partition by r, line order by no) as nth from lines where len(w) > 0
),
line_counts as (
  select r, count(*) as n_dup_lines, sum(len(array_to_string(w, ''))) as line_chars
  from copies where nth > 1 group by r
),
worded as (
  select r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from docs
),
tokens as (select r, unnest(w) as word, generate_subscripts(w, 1) as place from worded),
numbered as (select r, place, len(word) as chars, dense_rank() over (order by word) as v from tokens),
starts as (
  select r, place, size, lead(place, size - 1) over text as last,
         list(v) over (partition by size, r order by place rows between current row and 9 following)
         [1 : size] as gram
  from numbered, (select unnest([3, 5, 6, 7, 8, 9, 10]) as size)
  window text as (partition by size, r order by place)
),
repeats as (
  select r, size, place from starts where last is not null
  qualify count(*) over (partition by r, size, gram) > 1
),
marked as (
  select n.r, s.size, n.chars,
         max(p.place) over (partition by n.r, s.size order by n.place rows unbounded preceding)
         > n.place - s.size as inside
  from numbered n
  cross join (select unnest([3, 5, 6, 7, 8, 9, 10]) as size) s
  left join repeats p on p.r = n.r and p.size = s.size and p.place = n.place
),
sums as (
  select r, size, count(*) filter (where inside) as words, sum(chars) filter (where inside) as chars
  from marked group by r, size
),
shares as (
  select r, max(words) filter (where size = 3) as n_repeat_words,
         max(chars) filter (where size = 5) as chars_5, max(chars) filter (where size = 6) as chars_6,
         max(chars) filter (where size = 7) as chars_7, max(chars) filter (where size = 8) as chars_8,
         max(chars) filter (where size = 9) as chars_9, max(chars) filter (where size = 10) as chars_10
  from sums group by r
),
measured as (
  select doc_id, len(w)::bigint as n_words, len(array_to_string(w, ''))::bigint as word_chars,
         len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
         coalesce(line_chars, 0)::bigint as line_chars,
         coalesce(chars_5, 0)::bigint as chars_5, coalesce(chars_6, 0)::bigint as chars_6,
         coalesce(chars_7, 0)::bigint as chars_7, coalesce(chars_8, 0)::bigint as chars_8,
         coalesce(chars_9, 0)::bigint as chars_9, coalesce(chars_10, 0)::bigint as chars_10
  from docs join worded using (r) left join line_counts using (r) left join shares using (r)
),
based as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from measured
)
select *, not base_failed and 100 * line_chars <= 20 * word_chars
          and 100 * chars_5 <= 15 * word_chars and 100 * chars_6 <= 14 * word_chars
          and 100 * chars_7 <= 13 * word_chars and 100 * chars_8 <= 12 * word_chars
          and 100 * chars_9 <= 11 * word_chars and 100 * chars_10 <= 10 * word_chars as kept
from based
"""

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": OP1,
    "op4_embedding_dedup": OP4,
    "op11_collocations": OP11,
    "op13_quality": OP13,
}
