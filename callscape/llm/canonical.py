"""Visually identical text in one consistent form.

A quick check finds the characters that may not stand as they are: invisible ones, spaces other than the plain one,
wide, narrow and joined forms, combining marks, and letters that have a twin of the same look in another script. Only
segments around such characters are rewritten, each with its boundary context (the base letter before a mark, and the
whole word around a look-alike letter, as the word decides the script); everything else is kept as it is.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscape.functions.cluster import cut_lineage, spread

#: Letters of other scripts that look like Latin ones, in natural order (fixed values, after Unicode's table of confusable characters).
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХаеѕіјорсухһԛԝԁѵӏ", "ABESIJKMHOPCTXaesijopcyxhqwdvl", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνορϲͿϹϳ", "ABEZHIKMNOPTYXvopcJCj", strict=True))
ARMENIAN = dict(zip("ԼՍՏՕզհյոսցօ", "LUSOqhjnugo", strict=True))
CHEROKEE = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZRVSLCPKB", strict=True))
OTHER = dict(zip("ɑɡıʏԌ", "agiYG", strict=True))
#: By script, Latin letters and those that they stand for within a word of that script.
_SCRIPTS = {
    "Cyrillic": {v: k for k, v in CYRILLIC.items()},
    "Greek": {v: k for k, v in GREEK.items() if k not in "ϲϹ"},
    "Armenian": {v: k for k, v in ARMENIAN.items()},
    "Cherokee": {v: k for k, v in CHEROKEE.items()},
}
_TO_LATIN = {**CYRILLIC, **GREEK, **ARMENIAN, **CHEROKEE, **OTHER}
#: Forms that differ from their letters only in width or in being joined.
_FORMS = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")


def _joined(c: str) -> bool:
    """Letters in one character: ligatures, and the Roman numerals that are made of letters."""
    name = unicodedata.name(c, "")
    return ("LIGATURE" in name or "ROMAN NUMERAL" in name) and unicodedata.decomposition(c).startswith("<compat>")


#: Characters without a mark of their own that the categories do not tell (fixed values).
_INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ"


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[int, str], frozenset[str]]:
    """From the Unicode database: what single characters become, and the set of all unstable characters."""
    single: dict[int, str] = {}
    odd = []
    for o in range(sys.maxunicode + 1):
        c = chr(o)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Cs", "Co") or c in "\n ":
            continue
        if c in "\u2028\u2029":
            single[o] = "\n"
        elif kind == "Zs" or c in "\t\v\f":
            single[o] = " "
        elif kind in ("Cf", "Cc") or c in _INVISIBLE or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF:
            single[o] = ""
        elif unicodedata.decomposition(c).startswith(_FORMS) or _joined(c):
            single[o] = unicodedata.normalize("NFKC", c)
        elif unicodedata.combining(c) or not unicodedata.is_normalized("NFC", c):
            odd.append(c)
    return single, frozenset({*map(chr, single), *odd})


@lru_cache(maxsize=4096)
def _segments(unstable: frozenset[str]) -> re.Pattern:
    """Runs of these characters, each with the character before it: a base letter gives a mark its context."""
    chars = "".join(f"\\U{ord(c):08x}" for c in sorted(unstable))
    return re.compile(f"[^{chars}]?[{chars}]+")


_WORD = regex.compile(r"[\p{L}\p{M}]+")
#: Characters of scripts with letters that look like Latin ones; a word with one of them is looked at.
_ALONE = frozenset(chr(o) for a, z in ((0x370, 0x590), (0x13A0, 0x1400), (0x1F00, 0x2000), (0xA640, 0xA6A0)) for o in range(a, z)) | frozenset(_TO_LATIN)
_LATIN_MAP = {ord(k): v for k, v in _TO_LATIN.items()}
_SCRIPT_MAPS = {script: {ord(k): v for k, v in twins.items()} for script, twins in _SCRIPTS.items()}
_OF_SCRIPT = {script: regex.compile(rf"\p{{{script}}}") for script in _SCRIPTS}


@lru_cache(maxsize=65536)
def _word(word: str) -> str:
    """A word with its look-alike letters in one script.

    Letters with a Latin twin are Latin first. What is left of other scripts decides: the word is of the script that most
    of it belongs to (of equally many, the first of _SCRIPTS), and its Latin letters with a twin there become that
    one; with nothing left it is Latin.
    """
    latin = unicodedata.normalize("NFD", word).translate(_LATIN_MAP)
    left = {script: len(letters.findall(latin)) for script, letters in _OF_SCRIPT.items()}
    script = max(left, key=left.__getitem__)
    # i with breve and the like: the marks stay where they are and compose again
    return unicodedata.normalize("NFC", latin.translate(_SCRIPT_MAPS[script]) if left[script] else latin)


def canonical(text: str | None) -> str | None:
    """The text in one consistent form; None for None.

    Characters that print nothing go (a carriage return too), a space or tab of any kind is a space, line and
    paragraph separators are line breaks; width, ligatures, joined and composed forms are their letters (NFC);
    look-alike letters are those of their word's script. Case, accents, digits, superscripts, punctuation and the
    number of spaces stay. The form is a fixed point: canonical(canonical(t)) == canonical(t).
    """
    if text is None:
        return None
    single, unstable = _tables()
    chars = set(text)
    if not chars.isdisjoint(unstable):
        text = _segments(frozenset(chars & unstable)).sub(lambda m: unicodedata.normalize("NFC", m[0].translate(single)), text)
    if not unicodedata.is_normalized("NFC", text):
        # removing an invisible character has joined a base and its mark over a segment's limit
        text = unicodedata.normalize("NFC", text)
    if not chars.isdisjoint(_ALONE):
        text = _WORD.sub(lambda m: m[0] if m[0].isascii() else _word(m[0]), text)
    return text


def canonical_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the column `canonical`; all columns stay, and a column of that name is replaced."""

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(canonical, na_action="ignore").astype(object)

    return docs.withColumn("canonical", form(F.col(text)))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def looks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, look, own): digests (128 bits) of the canonical form and of the text as it is; null texts have none."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [_digest(t) for t in pdf["text"]]
            forms = [canonical(t) for t in pdf["text"]]
            look = [o if f is t or f == t else _digest(f) for f, t, o in zip(forms, pdf["text"], own, strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "look": look, "own": own})

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    return spread(rows, "doc_id").mapInPandas(scan, "doc_id bigint, look binary, own binary")


def look_alike_pairs(docs: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: texts that look alike but aren't equal, each pair once.

    Different texts of one look are paired first and their documents put in afterwards, so that the work is that of
    the pairs that come out: copies of one text, be they a third of all documents, are never held against each other.
    Texts are scanned once; 40 bytes a document are written to the shared folder.
    """
    rows = cut_lineage(looks(docs).distinct())
    mixed = rows.groupBy("look").agg(F.min("own").alias("_lo"), F.max("own").alias("_hi")).where("_lo <> _hi").select("look")
    rows = cut_lineage(rows.join(mixed, "look", "left_semi"))
    texts = rows.select("look", "own").distinct()
    a, b = texts.alias("a"), texts.alias("b")
    pairs = a.join(b, (F.col("a.look") == F.col("b.look")) & (F.col("a.own") < F.col("b.own"))).select(F.col("a.own").alias("own_a"), F.col("b.own").alias("own_b"))
    pairs = pairs.join(rows.select(F.col("own").alias("own_a"), F.col("doc_id").alias("_a")), "own_a").join(rows.select(F.col("own").alias("own_b"), F.col("doc_id").alias("_b")), "own_b")
    return pairs.where("_a <> _b").select(F.least("_a", "_b").alias("doc_a"), F.greatest("_a", "_b").alias("doc_b")).distinct()


def look_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_documents, n_texts): the documents of each look, by its smallest doc_id."""
    rows = cut_lineage(looks(docs).distinct())
    parts = rows.groupBy("look", "own").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    classes = parts.groupBy("look").agg(F.min("_first").alias("class_id"), F.sum("_n").alias("n_documents"), F.count(F.lit(1)).alias("n_texts"))
    return rows.join(classes, "look").select("doc_id", "class_id", "n_documents", "n_texts")
