"""Text as columns: tokens, folds, domains, outlets, redaction, replies. Native expressions but where Unicode forms are needed."""

from __future__ import annotations

import functools
import unicodedata
from pathlib import Path
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that tell no title apart, and the shortest fold that may match as a substring.
STOPWORDS = ("the", "a", "an", "of", "and", "or", "to", "in", "on", "at", "for", "part")
FOLD_MIN_CHARS = 6


# Ranges whose letters are composed already and that hold no combining marks: Latin, Cyrillic, kana, Han, Hangul, punctuation.
# Latin stands before the nested class, here and in words: so it is looked at first, and the other ranges only where it fails.
_COMPOSED = r"^[\x00-\u02FF[\u0400-\u0482\u048A-\u052F\u2010-\u2027\u2030-\u205E\u20A0-\u20C0\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF\uAC00-\uD7A3]]*$"
# Fixed pattern: an initialism is two or more pairs of a letter and a dot or slash, the first not after a letter or digit, and perhaps one more
# letter; from three letters on its separators go. As Spark's replacement has no conditions, one pair is replaced at a time, if what stands
# before and after makes the run long enough.
_PAIR = r"(?<![\p{L}\p{N}])\p{L}[./]"
_INITIALISM = rf"(?<![\p{{L}}\p{{N}}])(\p{{L}})[./](?=\p{{L}}[./]\p{{L}})|(?<={_PAIR})(\p{{L}})[./](?=\p{{L}})|(?<={_PAIR}\p{{L}}[./])(\p{{L}})[./]"


def lower_nfc(text: Column) -> Column:
    """Lower case in composed form. Only texts with characters that composing may change go to Python; for all others it gets a null."""
    @F.pandas_udf(T.StringType())
    def composed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x.lower()))

    return F.coalesce(composed(F.when(~text.rlike(_COMPOSED), text)), F.lower(text))  # the pattern is held against a text once


def collapse_initialisms(text: Column) -> Column:
    """Runs of three letters and more, each before a dot or slash, lose their separators (u.s.a. -> usa); shorter runs stay."""
    return F.when(text.rlike(r"[./](?<=\p{L}.)\p{L}[./]"), F.regexp_replace(text, _INITIALISM, "$1$2$3")).otherwise(text)


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores in order."""
    return F.regexp_extract_all(text, F.lit(r"[a-z0-9_[\p{L}\p{N}]]+"), F.lit(0))


def significant_tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Words longer than one character that are no stopwords, in order, repeats kept; initialisms are one word. Takes text in its normal form."""
    return F.filter(words(collapse_initialisms(text)), lambda w: (F.length(w) > 1) & ~w.isin(*stopwords))


def squash_fold(text: Column) -> Column:
    """Letters and digits alone."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")


def fold_within(title_fold: Column, text_fold: Column) -> Column:
    """Does a long enough title's fold stand in the text's?"""
    return F.coalesce((F.length(title_fold) >= FOLD_MIN_CHARS) & F.contains(text_fold, title_fold), F.lit(False))


def _plain_letters() -> tuple[str, str]:
    """Letters from U+00C0 to U+024F that decompose to a plain letter and marks, and these letters."""
    pairs = [(chr(c), d) for c in range(0xC0, 0x250) if (d := unicodedata.normalize("NFD", chr(c))[0]).isascii() and d != chr(c)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def search_fold(text: Column) -> Column:
    """Lower case, marks off, letters and digits alone: what a search box compares."""
    marked, plain = _plain_letters()
    return F.regexp_replace(F.translate(F.lower(text), marked, plain), r"[^\p{L}\p{N}]", "")


def alnum_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def outlet_key(outlet: Column) -> Column:
    """Case folded (upper, then lower case, so that letters like the sharp s count as what they stand for), one space between words, no leading "the "."""
    # not one right upon the other: Spark would take the inner one away
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.upper(outlet), r"\s+", " "))), "^the ", "")


def name_key(name: Column) -> Column:
    """Compatibility form, case folded, one space between words."""
    @F.pandas_udf(T.StringType())
    def keyed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))

    return keyed(name)


def slugify(text: Column) -> Column:
    """Lower-case ASCII words joined by hyphens; marks are taken off first."""
    marked, plain = _plain_letters()
    return F.regexp_replace(F.regexp_replace(F.translate(F.lower(text), marked, plain), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def leading_id(ref: Column) -> Column:
    """The number that begins a reference, alone or before a hyphen; null if none does."""
    return F.nullif(F.regexp_extract(ref, r"^(\d+)(?:-|$)", 1), F.lit("")).try_cast("long")


def url_host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def bare_host(url: Column) -> Column:
    return F.regexp_replace(url_host(url), r"^www\.", "")


class SuffixRules(NamedTuple):
    """Public suffixes by kind, without their marks: plain ones, those before which any one label belongs to the suffix, and names that are none in spite of it."""

    plain: frozenset[str]
    any_label: frozenset[str]
    no_suffix: frozenset[str]


@functools.cache
def suffix_rules(path: str | None = None, private: bool = False) -> SuffixRules:
    """The rules of a file in the format of the public suffix list (the package's own by default); private: those of hosting services too."""
    kinds: dict[str, set[str]] = {"": set(), "*": set(), "!": set()}
    within = True
    for line in (Path(path) if path else Path(__file__).with_name("public_suffixes.txt")).read_text("utf-8").splitlines():
        line = line.strip()
        if line.startswith("//"):
            within = private if "BEGIN PRIVATE" in line else True if "END PRIVATE" in line else within
        elif line and within:
            rule = line.split()[0].lower()
            kind = "*" if rule.startswith("*.") else "!" if rule.startswith("!") else ""
            kinds[kind].add(rule.removeprefix("*.").removeprefix("!"))
    return SuffixRules(*(frozenset(x) for x in kinds.values()))


def host_of(url: Column) -> Column:
    """The host of a url or of a bare host with a path; lower case, without user, port and final dots; null if it has a blank or no dot, and for addresses of numbers."""
    bare = F.lower(F.regexp_extract(url, r"^\s*(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//)?(?:[^/@?#]*@)?([^/:?#@]+)", 1))
    host = F.regexp_replace(bare, r"[.\u3002\uff0e\uff61]+$", "")
    return F.when(host.rlike(r"^[^\s.\[\]]+(\.[^\s.\[\]]+)+$") & ~host.rlike(r"^[0-9]+(\.[0-9]+){3}$"), host)


def public_labels(host: Column, rules: SuffixRules, unlisted: bool = True) -> Column:
    """How many of a host's labels are its public suffix: an exception's rule first, else the longest rule that fits.

    The last one to five labels are looked up in sets, so the number of rules doesn't count. unlisted: a last label that no rule names counts as a suffix; else the host has none (null).
    """
    n = F.length(host) - F.length(F.replace(host, F.lit("."))) + 1
    last = lambda k: F.substring_index(host, ".", -k)
    holds = lambda k, rules: (n >= k) & last(k).isin(*sorted(rules)) if rules else F.lit(False)
    depth = range(1, 2 + max(x.count(".") for kind in rules for x in kind) if any(rules) else 1)
    exempt = F.coalesce(*(F.when(holds(k, rules.no_suffix), k - 1) for k in reversed(depth)), F.lit(None).cast("int"))
    fits = [F.when(holds(k, rules.any_label) & (n > k), k + 1).when(holds(k, rules.plain), k) for k in depth]
    return F.coalesce(exempt, F.greatest(F.lit(1) if unlisted else F.lit(None).cast("int"), F.lit(None).cast("int"), *fits))


def registrable_domain(url: Column, rules: SuffixRules | None = None, unlisted: bool = True) -> Column:
    """The public suffix of the url's host and one label before it; null for a host that is a suffix itself, has no dot, or is an address of numbers."""
    host = host_of(url)
    public = public_labels(host, rules or suffix_rules(), unlisted)
    n = F.length(host) - F.length(F.replace(host, F.lit("."))) + 1
    return F.when(n > public, F.call_function("substring_index", host, F.lit("."), -(public + 1)))


def is_redirect(url: Column, hosts: tuple[str, ...], path_part: str) -> Column:
    return F.coalesce(url_host(url).isin(*hosts) & F.contains(url_path(url), F.lit(path_part)), F.lit(False))


def article_id(url: Column) -> Column:
    """The last part of the path, before any query."""
    return F.regexp_extract(url, r"([^/?]*)(?:\?.*)?$", 1)


def outlet_suffix(title: Column) -> Column:
    """What follows the last " - " of a headline; null if there is none."""
    return F.nullif(F.regexp_extract(title, r"(?s)^.* - (.*)$", 1), F.lit(""))


def headline(title: Column) -> Column:
    """A headline without its outlet."""
    return F.when(F.contains(title, F.lit(" - ")), F.regexp_extract(title, r"(?s)^(.*) - .*$", 1)).otherwise(title)


def json_span(text: Column, array: bool = False) -> Column:
    """From the first opening bracket to the last closing one; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])" if array else r"(?s)(\{.*\})", 1), F.lit(""))


def recovered_summary(reply: Column, limit: int = 400) -> Column:
    """The summary field of a reply that is no clean JSON: control characters off, white space collapsed.

    Null for what is longer than limit or holds a code fence.
    """
    found = F.nullif(F.regexp_extract(reply, r'(?s)"summary"\s*:\s*"(.*)"\s*\}?', 1), F.lit(""))
    clean = F.trim(F.regexp_replace(F.regexp_replace(found, r"[\x00-\x1f\x7f]", " "), r"\s+", " "))
    return F.when((F.length(clean) > 0) & (F.length(clean) <= limit) & ~F.contains(clean, F.lit("```")), clean)


def redact_url(url: Column, names: tuple[str, ...] = ("api_key", "key", "token", "access_token")) -> Column:
    """Values of secret query parameters become REDACTED."""
    return F.regexp_replace(url, rf"([?&](?:{'|'.join(names)})=)[^&#\s]*", "$1REDACTED")


def xml_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def prose_list(items: Column) -> Column:
    """"A", "A and B", "A, B and C"."""
    n = F.size(items)
    return F.when(n == 0, "").when(n == 1, F.get(items, F.lit(0))).otherwise(
        F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(" and "), F.try_element_at(items, n)))


def html_attribute(html: Column, name: str) -> Column:
    """The first value of an attribute."""
    return F.nullif(F.regexp_extract(html, rf'\s{name}="([^"]*)"', 1), F.lit(""))


def register(spark) -> None:
    """The functions that need Python, by name, for SQL."""
    @F.pandas_udf(T.StringType())
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x.lower()))

    @F.pandas_udf(T.StringType())
    def key(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))

    spark.udf.register("lower_nfc", nfc)
    spark.udf.register("name_key", key)
