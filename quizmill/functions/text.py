"""Normalisers and tokenisers as Column builders.

Each rule of the catalogue names the normaliser it needs; they are not interchangeable. Accents are folded with one
`translate` over a table made from Unicode's compatibility decompositions, so that all of it stays in generated code
and an SQL engine with the same table gives the same result.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
NOT_WORD = r"[^\p{L}\p{N}_]+"
MARKS = r"[̀-ͯ҃-֑҇-ֽً-ٟ᪰-᫿᷀-᷿⃐-⃿︠-︯]"


@cache
def fold_table() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to) of characters that decompose to one base letter, and those that give several: Latin, Greek, Cyrillic and letter-like blocks."""
    one_from, one_to, many = [], [], []
    for block in (range(0xA0, 0x530), range(0x1E00, 0x2000), range(0x2070, 0x20A0), range(0x2100, 0x2190), range(0xFB00, 0xFB07), range(0xFF01, 0xFF5F)):
        for c in map(chr, block):
            plain = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x)).casefold()
            if plain != c and plain:
                if len(plain) == 1:
                    one_from.append(c)
                    one_to.append(plain)
                else:
                    many.append((c, plain))
    return "".join(one_from), "".join(one_to), tuple(many)


#: Latin letters as they are folded one by one; the dotted capital i is none of them, as it gives two.
_LATIN = r"^[\x00-\x{12F}\x{131}-\x{24F}]*+$"
_SEVERAL = "ßﬁﬂ½¼¾…ﬀ"  # what texts hold; others of this kind are left as they are


@cache
def latin_table() -> tuple[str, str]:
    """(from, to) of Latin characters that lower case and `fold_table` change to one character."""
    a, b, _ = fold_table()
    plain = dict(zip(a, b, strict=True))
    found = {c: plain.get(c.lower(), c.lower()) for c in map(chr, range(0x250)) if c != "İ"}
    return "".join(c for c, x in found.items() if x != c), "".join(x for c, x in found.items() if x != c)


def fold(c: Column) -> Column:
    """Case folded, decomposed, without combining marks. ASCII needs lower case alone, Latin one table; the steps one by one are for the rest."""
    a, b, many = fold_table()
    latin, other = c, F.lower(c)
    for x, y in many:
        if x in _SEVERAL:
            other = F.replace(other, F.lit(x), F.lit(y))
            if x < "ɐ":
                latin = F.replace(latin, F.lit(x), F.lit(y))
    other = F.regexp_replace(F.translate(other, a, b), MARKS, "")
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).when(c.rlike(_LATIN), F.translate(latin, *latin_table())).otherwise(other)


def _or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def ascii_fold(c: Column) -> Column:
    """Decomposed, everything outside ASCII dropped (so is the sharp s), case folded."""
    return F.regexp_replace(fold(F.replace(_or_empty(c), F.lit("ß"), F.lit(""))), r"[^\x00-\x7F]", "")


def words_folded(c: Column) -> Column:
    """Folded, anything but letters, digits and _ becomes one space, trimmed."""
    return words_of(fold(_or_empty(c)))


def words_of(folded: Column) -> Column:
    """`words_folded` of a text that is folded."""
    return F.trim(F.regexp_replace(folded, NOT_WORD, " "))


def spaces_folded(c: Column) -> Column:
    """Folded, white space collapsed, punctuation kept."""
    return spaces_of(fold(_or_empty(c)))


def spaces_of(folded: Column) -> Column:
    """`spaces_folded` of a text that is folded."""
    return F.trim(F.regexp_replace(folded, r"\s+", " "))


def plain_folded(c: Column) -> Column:
    """Folded, nothing else."""
    return fold(_or_empty(c))


def short_key(c: Column) -> Column:
    """Folded, only letters, digits and _."""
    return F.regexp_replace(fold(_or_empty(c)), NOT_WORD, "")


def token_base(c: Column) -> Column:
    """Folded, only a-z and 0-9."""
    return F.regexp_replace(fold(_or_empty(c)), "[^a-z0-9]", "")


def accented_key(c: Column) -> Column:
    """Lower case, only letters, digits and _, accents kept."""
    return F.regexp_replace(F.replace(F.lower(_or_empty(c)), F.lit("ß"), F.lit("ss")), NOT_WORD, "")


def code_slug(c: Column, default: str = "CUSTOM") -> Column:
    """ASCII, runs of others become _, upper case, 48 characters."""
    s = F.regexp_replace(F.regexp_replace(ascii_fold(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    s = F.upper(F.substring(s, 1, 48))
    return F.when(s == "", default).otherwise(s)


def seed_slug(c: Column, default: str = "seed") -> Column:
    """Accented letters are dropped, not folded; joined by -."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(_or_empty(c), r"[^\x00-\x7F]", "")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", default).otherwise(s)


def falsy(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.when(c != "", c) for c in cols))


def words(c: Column) -> Column:
    """Words of letters, digits and _."""
    return F.regexp_extract_all(_or_empty(c), F.lit(WORD), F.lit(0))


def letter_tokens(c: Column) -> Column:
    """Tokens that begin with a letter of Latin-1."""
    return F.regexp_extract_all(_or_empty(c), F.lit("[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ0-9_-]*"), F.lit(0))


def plain_tokens(c: Column) -> Column:
    """T4: runs of a-z and 0-9 of the folded text."""
    return F.regexp_extract_all(plain_folded(c), F.lit("[a-z0-9]+"), F.lit(0))


#: Words that triage leaves out.
TRIAGE_STOP = ["a", "o", "as", "os", "de", "da", "do", "das", "dos", "e", "em", "um", "uma", "para", "por"]


def triage_words(c: Column) -> Column:
    """T5: distinct tokens of more than two characters outside the stop list."""
    return triage_words_of(plain_folded(c))


def triage_words_of(folded: Column) -> Column:
    found = F.regexp_extract_all(folded, F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*TRIAGE_STOP)))


#: Words that retrieval leaves out. Those with accents never meet a folded token.
RETRIEVAL_STOP = """
que para uma umas uns com dos das pelo pela entre sobre como qual quais este esta esse essa
sao seu sua seus suas analisar identificar compreender computacao especifico enade objetivo
avaliar explicar comparar diferenciar descrever distinguir funcao funcoes principal conceito
conceitos funcionamento exemplo exemplos aplicacao aplicacoes uso usos sistema sistemas dados
software estudante consegue partir cenário cenario situação situacao problema correto correta
melhor seguintes considerando relação relacao acordo deve podem possui possuiem
""".split()
SHORT_TERMS = ["ip", "ia", "p", "np"]


def canonical(c: Column, aliases: dict[str, list[str]] | None = None) -> Column:
    """N1, then each alias, longest first, replaced by its concept where it stands between non-word characters."""
    c = ascii_fold(c)
    pairs = [(a, k) for k, names in (aliases or {}).items() for a in names]
    for alias, concept in sorted(pairs, key=lambda x: -len(x[0])):
        plain = "".join(x for x in unicodedata.normalize("NFKD", alias) if ord(x) < 128).casefold()
        quoted = "".join("\\" + x if x in r"\.+*?^$()[]{}|-" else x for x in plain)
        c = F.regexp_replace(c, rf"{quoted}(?![a-z0-9_])(?<![a-z0-9_]{quoted})", concept)  # plain letters first: the JVM leaps over what cannot match
    return F.trim(F.regexp_replace(c, r"[\t\n\x0B\f\r]\s*+|\x20\s++", " "))  # single spaces, by far the most, are left alone


def unigrams(c: Column, aliases: dict[str, list[str]] | None = None, stop: list[str] | None = None) -> Column:
    return unigrams_of(canonical(c, aliases), stop)


def unigrams_of(c: Column, stop: list[str] | None = None) -> Column:
    """Of a canonical text, the tokens that count."""
    stop = RETRIEVAL_STOP if stop is None else stop
    raw = F.regexp_extract_all(c, F.lit("[a-z0-9_]+"), F.lit(0))
    return F.filter(raw, lambda t: ((F.length(t) > 2) | t.isin(*SHORT_TERMS)) & (~t.isin(*stop) if stop else F.lit(True)))


def with_bigrams(uni: Column) -> Column:
    """Unigrams and the pairs of neighbours that are left once stop words are gone."""
    pairs = F.zip_with(F.slice(uni, F.lit(1), F.greatest(F.size(uni) - 1, F.lit(0))), F.slice(uni, F.lit(2), F.greatest(F.size(uni) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("__"), b))
    return F.concat(uni, F.when(F.size(uni) > 1, pairs).otherwise(F.array().cast("array<string>")))


def plural_base(t: Column) -> Column:
    """Inflection folded: -ais, -eis, -ois, -oes and -s."""
    n = F.length(t)
    cut = lambda k, end: F.concat(F.substring(t, F.lit(1), n - k), F.lit(end))
    return F.when((n > 6) & t.endswith("ais"), cut(3, "al")).when((n > 6) & t.endswith("eis"), cut(3, "el")).when((n > 6) & t.endswith("ois"), cut(3, "ol")).when((n > 6) & t.endswith("oes"), cut(3, "ao")).when((n > 4) & t.endswith("s"), F.substring(t, F.lit(1), n - 1)).otherwise(t)


def same_inflection(a: Column, b: Column) -> Column:
    """Equal bases, or bases of six and more letters that differ in a final a or o."""
    x, y = plural_base(token_base(a)), plural_base(token_base(b))
    ends = F.right(x, F.lit(1)).isin("a", "o") & F.right(y, F.lit(1)).isin("a", "o")
    return (x == y) | ((F.length(x) == F.length(y)) & (F.length(x) >= 6) & (F.substring(x, F.lit(1), F.length(x) - 1) == F.substring(y, F.lit(1), F.length(y) - 1)) & ends)


def half_split(c: Column, buckets: int = 10_000) -> Column:
    """A stable number below `buckets` from the SHA-256 of a key: the 256-bit number modulo buckets, 16 bits at a time."""
    h = F.sha2(_or_empty(c), 256)
    parts = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(h, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: (acc * 65536 + x) % buckets)
