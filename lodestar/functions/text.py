"""Text expressions as columns: folding, tokens, sentences, line filters, cleaning and windows."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every small letter that Unicode takes apart into a Latin letter and marks, by that letter, and the marks alone.
_PLAIN_OF = {c: d[0] for c in map(chr, range(0x80, 0x10000)) if c == c.lower() and len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii() and d[0].isalpha() and d[0] == d[0].lower()}
MARKED, PLAIN = "".join(_PLAIN_OF) + "".join(map(chr, range(0x300, 0x370))), "".join(_PLAIN_OF.values())
#: Fixed value: what a token is.
TOKEN = r"[a-z0-9]+(?:\.[a-z0-9]+)*"
#: Elements of a page that carry no content.
NOISE_TAGS = ("script", "style", "nav", "header", "footer", "aside", "form", "noscript", "svg")
#: Phrases of forms, consent banners and widgets; a line that holds one is no content.
BOILERPLATE = (
    "not you?", "clear form", "welcome back.", "log out", "wcm mode cookie", "your privacy choices",
    "please share your contact details", "aem https", "inject web client", "fab button", "modal backdrop", "chat modal",
    "see console for details", "before bc initializes", "powered by adobe", "close button (external",
)
#: Lines that are a page's furniture.
FURNITURE = (
    "pular para o conteúdo", "pular para o menu", "pular para o rodapé", "ir para o conteúdo", "copiar link?", "leitura:",
    "compartilhar:", "tags:", "no seu e-mail", "ver todos os resultados", "ler o resumo da matéria",
    "ler um resumo desta notícia", "leia um resumo desta notícia",
)


def fold(text: Column) -> Column:
    """Small letters without marks."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), 0)


def tokens(text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Folded tokens of two letters or more that are no stopword; dotted names stay whole."""
    return F.filter(raw_tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(*stopwords) if stopwords else F.length(t) > 1)


def sentences(text: Column) -> Column:
    """Trimmed parts between sentence ends followed by white space, or line ends."""
    return F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s))


def long_sentences(text: Column, over: int = 40) -> Column:
    return F.filter(sentences(text), lambda s: F.length(s) > over)


def contains_any(text: Column, terms: list[str]) -> Column:
    return reduce(Column.__or__, (text.contains(t) for t in terms), F.lit(False))


def starts_word(text: Column, term: str) -> Column:
    """A boundary before the term only, so a plural matches too."""
    return text.rlike(r"\b" + re.escape(term))


def whole_word(text: Column, term: str) -> Column:
    return text.rlike(r"(?i)\b" + re.escape(term) + r"\b")


def vetoed_by_third_party(text: Column, term: str, markers: list[str]) -> Column:
    """True if the term occurs, and every sentence that holds it holds a marker as well."""
    holding = F.filter(F.split(F.lower(text), r"[.!?;\n]+"), lambda s: s.contains(term))
    return (F.size(holding) > 0) & F.forall(holding, lambda s: contains_any(s, markers))


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def strip_noise_tags(html: Column) -> Column:
    """Without comments and noise elements, content included."""
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(html, r"(?is)<(" + "|".join(NOISE_TAGS) + r")\b[^>]*>.*?</\1\s*>", "")


def strip_tags(html: Column) -> Column:
    """One line for each tag boundary."""
    return F.regexp_replace(html, r"(?s)<[^>]+>", "\n")


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(" \t\n\r\f\v"))


#: Elements inside a line.
INLINE_TAGS = ("a", "strong", "b", "em", "i", "span", "abbr", "mark", "sup", "sub", "code")
_INLINE = rf"(?i)</?(?:{'|'.join(INLINE_TAGS)})\b[^>]*>"


def longest_block(html: Column) -> Column:
    """The longest text among a page's ``<main>`` and ``<article>`` elements and its body, noise elements left out: elements inside a
    line leave it whole, all others begin a line; lines are trimmed and empty ones go. Of equally long ones the first."""
    bare = strip_noise_tags(html)
    inside = lambda tag: F.regexp_extract_all(bare, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), 1)
    body = F.coalesce(F.nullif(F.regexp_extract(bare, r"(?is)<body\b[^>]*>(.*)</body\s*>", 1), F.lit("")), bare)
    lines = lambda block: F.split(strip_tags(F.regexp_replace(block, _INLINE, "")), "\n")
    text = lambda block: F.array_join(F.filter(F.transform(lines(block), strip), lambda x: x != ""), "\n")
    texts = F.transform(F.concat(inside("main"), inside("article"), F.array(body)), text)
    return F.array_max(F.transform(texts, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("first"), t.alias("t"))))["t"]


def one_gap(text: Column) -> Column:
    """Three line ends or more become two; no white space at either end."""
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def clean_lines(text: Column) -> Column:
    """Trimmed lines of over two words or with a sentence's end; all others go, empty ones too."""
    trimmed = F.transform(F.split(text, "\n"), strip)
    kept = F.filter(trimmed, lambda line: line.rlike(r"\S\s+\S+\s+\S") | line.rlike("[.!?:]$"))
    return one_gap(F.array_join(kept, "\n"))


def drop_boilerplate(text: Column, phrases: tuple[str, ...] | list[str] = BOILERPLATE) -> Column:
    """Without lines that hold a phrase, a run of eight ``=``, a leading ``*`` or left-over markup."""
    bad = lambda low: contains_any(low, list(phrases)) | low.rlike(r"={8}|^\s*\*|<a href|<center|class=\"")
    return one_gap(F.array_join(F.filter(F.split(text, "\n"), lambda line: ~bad(F.lower(line))), "\n"))


#: A Markdown text as pieces: comments, heading tags with the white space inside, other tags, bracket groups with their
#: address, words in a row, and what is left, sign by sign.
_HEAD, _HEAD_END, _GROUP = r"<[hH][1-6]\b[^>]*>\s*", r"\s*</[hH][1-6]\s*>", r"!?\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*){0,5}\]\([^()]*\)"
PIECE = rf"(?s)<!--.*?-->|{_HEAD}|{_HEAD_END}|<[^<>]+>|{_GROUP}|[^\s<!\[]+(?:\s+[^\s<!\[]+){{0,50}}|."


def _shown(piece: Column) -> Column:
    """What is left of a piece."""
    label = F.regexp_extract(piece, r"(?s)^\[(.*)\]\([^()]*\)$", 1)
    heading = F.concat(F.lit("\n"), F.repeat(F.lit("#"), F.substring(piece, 3, 1).cast("int")), F.lit(" "))
    return (
        F.when(piece.rlike(rf"^{_HEAD}$"), heading)
        .when(piece.rlike(rf"^{_HEAD_END}$"), "\n")
        .when(piece.rlike("(?s)^<.+>$"), "")
        .when(piece.rlike(rf"^{_GROUP}$"), F.when(piece.startswith("!") | label.startswith("!["), "").otherwise(label))
        .otherwise(piece)
    )


def clean_markdown(text: Column) -> Column:
    """Heading tags as ``#`` lines, links as their text; comments, images, badges and other tags go. Code, rulers and rows
    of tables stay, but for lines of one lone bar, dash or dot, or of white space only."""
    shown = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(PIECE), 0), _shown), "")
    bare = lambda line: F.btrim(line, F.lit(" \t\r\f\v"))
    lines = F.filter(F.split(shown, "\n"), lambda line: ~bare(line).isin("|", "-", "·") & ((line == "") | (bare(line) != "")))
    return one_gap(F.array_join(F.transform(lines, lambda line: F.rtrim(line, F.lit(" \t\r\f\v"))), "\n"))


def title_of(text: Column, kind: str, default: Column) -> Column:
    """A page's ``<title>``, or the first line of a Markdown text that begins with ``#``; else ``default``."""
    found = F.regexp_extract(text, r"(?is)<title[^>]*>\s*(.*?)\s*</title>", 1) if kind == "html" else F.regexp_extract(text, r"(?m)^[ \t]*#[# \t]*(.*?)[ \t]*$", 1)
    return F.coalesce(F.nullif(found, F.lit("")), default)


def orphan_lines(text: Column, furniture: tuple[str, ...] | list[str] = FURNITURE) -> Column:
    """Lines that are page furniture, or of three signs at most without a letter or digit."""
    lines = F.transform(F.split(text, "\n"), strip)
    return F.filter(lines, lambda x: F.lower(x).isin(*furniture) | (F.length(x).between(1, 3) & ~x.rlike(r"[\p{L}\p{N}]")))


def fixed_windows(text: Column, size: int = 800, overlap: float = 0.15) -> Column:
    """Windows of ``size`` characters, each beginning a step after the last, until the end is covered."""
    step = int(size * (1 - overlap))
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step).cast("int")) * step
    cut = F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda at: F.substring(text, at + 1, F.lit(size)))
    return F.filter(cut, lambda w: F.trim(w) != "")


def shorten(text: Column, limit: int) -> Column:
    """Cut at the last space inside the limit, with an ellipsis that counts."""
    if limit <= 1:
        return F.substring(text, 1, max(0, limit))
    head = F.regexp_extract(F.substring(text, 1, limit - 1), r"(?s)^(.*)\s", 1)
    cut = F.when(head != "", F.rtrim(head)).otherwise(F.substring(text, 1, limit - 1))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("…")))


def present(text: Column, terms: list[str]) -> Column:
    """The terms that occur in the text, in the list's order."""
    return F.filter(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(text, t))
