"""Queries of the problems on texts and listings."""

from pyspark.sql import functions as F

from placewright.llm import addresses, leaks, near_dup, reading, tokens
from placewright.sources.tables import table


def p1_found(spark, d):
    return addresses.matches(table(spark, d, "silver_places"))


def p1_addresses(spark, d):
    """The linear form: one row per id and settled address, instead of pairs."""
    return addresses.resolved(table(spark, d, "silver_places"))


def listings(spark, d):
    return near_dup.columns_as_words(table(spark, d, "silver_places"), "id", F.col("name"), F.col("description"), near_dup.bare_site(F.col("website")))


def p4_found(spark, d):
    return near_dup.near_duplicate_pairs(listings(spark, d))


def p4_links(spark, d):
    """The linear form: one row per listing with its class and number of links, instead of pairs."""
    return near_dup.near_duplicate_links(listings(spark, d))


def p7_ids(spark, d):
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text", tokens.vocabulary_path("byte_bpe_50k.tiktoken"))


def p8_found(spark, d):
    return leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text").select("doc_id", "item_id")


def p8_paraphrases(spark, d):
    found = leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", cosine=0.8, least=6)
    return found.select("doc_id", "item_id", "lcs")


def p9_found(spark, d):
    docs = table(spark, d, "documents").where(~F.coalesce(F.col("lang"), F.lit("")).isin("de", "es"))
    return reading.reading_levels(docs, table(spark, d, "level_labels")).select("doc_id", "reading_level")


QUERIES = {"p1_found": p1_found, "p1_addresses": p1_addresses, "p4_found": p4_found, "p4_links": p4_links, "p7_ids": p7_ids, "p8_found": p8_found, "p8_paraphrases": p8_paraphrases, "p9_found": p9_found}
P4_FOUND_SQL = r"""
with s as (select distinct id, name, description,
                  regexp_replace(regexp_replace(regexp_replace(lower(website), '^\s*[a-z][a-z0-9+.\-]*://', ''), '^\s*www\.', ''), '[?#].*$', '', 's') site
           from silver_places where id is not null),
     w as (select distinct id, set_no, unnest(words) word, len(words) n
           from (select id, row_number() over () set_no, list_distinct(regexp_extract_all(strip_accents(lower(concat_ws(' ', name, description, site))), '[\p{L}\p{N}]+')) words from s)),
     j as (select a.id id_a, b.id id_b, a.set_no, b.set_no other, count(*) shared, any_value(a.n) n_a, any_value(b.n) n_b
           from w a join w b on a.word = b.word and a.id < b.id group by a.id, b.id, a.set_no, b.set_no)
select distinct id_a, id_b from j where 5 * shared >= 3 * (n_a + n_b - shared)
"""

#: Entities are read as far as the texts have them; the others part words. Both readings of a hyphen at a line's end count.
P8_FOUND_SQL = r"""
with src as (select 'd' side, doc_id k, text t from documents where text is not null union all select 'i', item_id, text from eval_items where text is not null),
     e as (select side, k, regexp_replace(regexp_replace(t, '&([A-Za-z])(acute|grave|circ|uml|cedil|tilde);', '\1', 'g'), '&[A-Za-z]+;|&#[0-9]+;', ' ', 'g') t from src),
     h as (select side, k, regexp_replace(t, '[-\x{ad}\x{2010}\x{2011}][ \t]*(\r\n|\r|\n)[ \t]*', '', 'g') t from e
           union select side, k, regexp_replace(t, '[-\x{ad}\x{2010}\x{2011}][ \t]*(\r\n|\r|\n)[ \t]*', ' ', 'g') from e),
     f as (select side, k, regexp_replace(strip_accents(lower(regexp_replace(t, '[\x{ad}\x{34f}\x{61c}\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{fe00}-\x{fe0f}\x{feff}]', '', 'g'))), '\p{M}+', '', 'g') t from h),
     w as (select side, k, regexp_extract_all(t, '[\p{L}\p{N}]+') w from f),
     g as (select distinct side, k, array_to_string(w[n:n + 7], ' ') gram from (select side, k, w, unnest(generate_series(1, len(w) - 7)) n from w))
select distinct d.k as doc_id, i.k as item_id from g d join g i on d.side = 'd' and i.side = 'i' and d.gram = i.gram
"""

SQL = {"p4_found": P4_FOUND_SQL, "p8_found": P8_FOUND_SQL}
