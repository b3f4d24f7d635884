"""Column expressions over text, names, titles, links and identifiers; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scripts that are written without spaces, and the letters of Latin words.
CONTINUA = "㐀-䶿一-鿿぀-ヿ가-힣"
LATIN = "a-z0-9À-ÖØ-öø-ɏ"
TOKEN = rf"[{CONTINUA}]+|[{LATIN}]+|[\p{{L}}\p{{Nl}}\p{{No}}]+"
TITLE_LEAST = 20
ARXIV_LINK = r"(?i)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})"
DOI = r"(?i)(10\.\d{4,9}/[-._;()/:a-z0-9]+)"


def tokens(text: Column) -> Column:
    """Words of every script in text order; runs of scripts without spaces become overlapping pairs of characters."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))
    split = F.flatten(F.transform(found, lambda w: F.when(w.rlike(f"^[{CONTINUA}]"), pairs(w)).otherwise(F.array(w))))
    return F.when(text.rlike(f"[{CONTINUA}]"), split).otherwise(found)  # most texts have no such run, and need no look at each word


def query_terms(text: Column) -> Column:
    """Distinct tokens in order, without single ASCII characters."""
    return F.filter(F.array_distinct(tokens(text)), lambda t: (F.length(t) > 1) | ~t.rlike(r"^[\x00-\x7f]$"))


def segment(*fields: Column) -> Column:
    """The searchable form of a document: its fields' tokens, joined by blanks."""
    return F.array_join(tokens(F.concat_ws(" ", *fields)), " ")


def normal_title(title: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def normal_url(url: Column) -> Column:
    """Without query, fragment, trailing slashes, scheme and ``www.``; lower-case."""
    cut = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#][\s\S]*$", ""), "/+$", "")
    return F.regexp_replace(F.lower(cut), r"^https?://(www\.)?", "")


def normal_doi(doi: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(doi)), r"^https?://(dx\.)?doi\.org/", "")


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1), F.lit(""))


def arxiv_in(url: Column) -> Column:
    return _found(url, ARXIV_LINK)


def doi_in(url: Column) -> Column:
    return F.lower(_found(url, DOI))


def fingerprint(title: Column, doi: Column, url: Column, source: Column, source_id: Column) -> Column:
    """One key for one work: a long title, else a DOI, an arXiv id or DOI in the link, the link, or the row's own identity."""
    name, link = normal_title(title), normal_url(url)
    return F.coalesce(
        F.when(F.length(name) >= TITLE_LEAST, F.concat(F.lit("title:"), name)),
        F.concat(F.lit("doi:"), normal_doi(F.nullif(doi, F.lit("")))),
        F.concat(F.lit("arxiv:"), arxiv_in(url)),
        F.concat(F.lit("doi:"), doi_in(url)),
        F.when(link != "", F.concat(F.lit("url:"), link)),
        F.concat(F.lit("id:"), source, F.lit(":"), source_id),
    )


def strong_ids(doi: Column, arxiv: Column, url: Column) -> Column:
    """The DOI and arXiv identities of a row; rows that share one are one work."""
    return F.array_distinct(F.array_compact(F.array(
        F.concat(F.lit("doi:"), normal_doi(F.nullif(doi, F.lit("")))), F.concat(F.lit("arxiv:"), F.trim(F.nullif(arxiv, F.lit("")))),
        F.concat(F.lit("arxiv:"), arxiv_in(url)), F.concat(F.lit("doi:"), doi_in(url)),
    )))


def name_tokens(name: Column) -> Column:
    """Distinct ASCII words of at least two letters, lower-case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), "[^a-z]+"), lambda w: F.length(w) >= 2))


def name_key(name: Column) -> Column:
    return F.array_join(F.array_sort(name_tokens(name)), " ")


def name_matches(asked: Column, candidate: Column) -> Column:
    """Whether every word of the name that is asked for is in the candidate's."""
    words = name_tokens(asked)
    return (F.size(words) > 0) & (F.size(F.array_except(words, name_tokens(candidate))) == 0)


def canonical_label(label: Column) -> Column:
    words = tokens(label)
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(F.lower(F.trim(label)))


def statement_type(kind: Column) -> Column:
    """A slug of at most 40 characters for the type of a statement."""
    slug = F.regexp_replace(F.lower(F.trim(kind)), r"[^a-z0-9_]+", "_")
    return F.trim(F.substring(F.regexp_replace(slug, "_+", "_"), 1, 40), F.lit("_"))


def hook(title: Column, content: Column, terms: Column, cap: int = 120) -> Column:
    """The first sentence, of title and beginning of the content, with most query terms; empty if none has any."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.substring(F.coalesce(content, F.lit("")), 1, 500))
    sentences = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n|。"), lambda s: F.trim(s)), lambda s: s != "")
    counted = F.transform(sentences, lambda s, i: F.struct(F.size(F.array_intersect(terms, tokens(s))).alias("n"), (-i).alias("i"), s.alias("s")))
    best = F.array_max(F.filter(counted, lambda x: x["n"] > 0))
    return F.coalesce(F.substring(best["s"], 1, cap), F.lit(""))


def passages(title: Column, content: Column, size: int = 2000, most: int = 16) -> Column:
    """The slices of a content beyond its first ``size`` characters, each under the title; blank ones are left out."""
    count = F.least(F.lit(most), F.ceil((F.length(content) - size) / size).cast("int"))
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    cut = F.filter(F.transform(starts, lambda i: F.substring(content, i * size + 1, F.lit(size))), lambda s: F.trim(s) != "")
    return F.transform(cut, lambda s: F.concat_ws("\n", title, s))


def without_images(markdown: Column) -> Column:
    """Markdown without images that are written into it."""
    return F.regexp_replace(markdown, r"!\[[^\]]*\]\(data:image/[^)]*\)", "")


def seconds(clock: Column) -> Column:
    """``[[h:]m:]s`` as seconds."""
    return F.aggregate(F.transform(F.split(clock, ":"), lambda p: p.try_cast("double")), F.lit(0.0).cast("double"), lambda a, x: a * 60 + x)


def page_text(html: Column) -> Column:
    """The visible text of a page: no scripts, styles, navigation or tags; white space is squeezed."""
    body = F.regexp_replace(html, r"(?is)<(script|style|noscript|nav|header|footer|svg)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]+>", " "), r"\s+", " "))
