"""Portuguese stemming by suffixes, as staged column expressions over distinct terms.

The rules are those of the published Snowball description for Portuguese: three regions of a word, then standard suffixes
or else verb suffixes, then what is left of a suffix. Only the distinct terms of a corpus are stemmed; postings are joined
with the result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the description: vowels, and the suffixes of its steps. A nasal vowel is written with a tilde behind it.
VOWELS = "aeiouáéíóúâêô"
DELETED = (
    "eza", "ezas", "ico", "ica", "icos", "icas", "ismo", "ismos", "ável", "ível", "ista", "istas", "oso", "osa", "osos", "osas",
    "amento", "amentos", "imento", "imentos", "adora", "ador", "aça~o", "adoras", "adores", "aço~es", "ante", "antes", "ância",
)
REPLACED = {"logia": "log", "logias": "log", "uça~o": "u", "uço~es": "u", "ência": "ente", "ências": "ente"}
VERBAL = (
    "ada", "ida", "ia", "aria", "eria", "iria", "ará", "ara", "erá", "era", "irá", "ava", "asse", "esse", "isse", "aste", "este", "iste",
    "ei", "arei", "erei", "irei", "am", "iam", "ariam", "eriam", "iriam", "aram", "eram", "iram", "avam", "em", "arem", "erem", "irem",
    "assem", "essem", "issem", "ado", "ido", "ando", "endo", "indo", "ara~o", "era~o", "ira~o", "ar", "er", "ir", "as", "adas", "idas",
    "ias", "arias", "erias", "irias", "arás", "aras", "erás", "eras", "irás", "avas", "es", "ardes", "erdes", "irdes", "ares", "eres",
    "ires", "asses", "esses", "isses", "astes", "estes", "istes", "is", "ais", "eis", "íeis", "aríeis", "eríeis", "iríeis", "áreis",
    "areis", "éreis", "ereis", "íreis", "ireis", "ásseis", "ésseis", "ísseis", "áveis", "ados", "idos", "ámos", "amos", "íamos",
    "aríamos", "eríamos", "iríamos", "áramos", "éramos", "íramos", "ávamos", "emos", "aremos", "eremos", "iremos", "ássemos",
    "êssemos", "íssemos", "imos", "armos", "ermos", "irmos", "eu", "iu", "ou", "ira", "iras",
)
RESIDUAL = ("os", "a", "i", "o", "á", "í", "ó")
#: Common words of Portuguese that carry no content: articles, prepositions, pronouns, conjunctions, forms of a few verbs.
STOPWORDS = (
    "a", "ao", "aos", "aquela", "aquele", "aquilo", "as", "até", "com", "como", "da", "das", "de", "dela", "dele", "delas", "deles",
    "depois", "do", "dos", "e", "ela", "elas", "ele", "eles", "em", "entre", "era", "essa", "essas", "esse", "esses", "esta", "estas",
    "este", "estes", "eu", "foi", "for", "foram", "há", "isso", "isto", "já", "lhe", "lhes", "mais", "mas", "me", "mesmo", "meu",
    "minha", "muito", "na", "nas", "nem", "no", "nos", "nossa", "nosso", "num", "numa", "não", "nós", "o", "os", "ou", "para", "pela",
    "pelas", "pelo", "pelos", "por", "qual", "quando", "que", "quem", "se", "sem", "ser", "seu", "seus", "sua", "suas", "são", "só",
    "também", "te", "tem", "ter", "teu", "tu", "tua", "um", "uma", "você", "vocês", "vos", "à", "às", "é",
)
_V, _C = f"[{VOWELS}]", f"[^{VOWELS}]"
#: What stands before the regions of a word.
REGIONS = {"rv": f"^(?:.{_C}+{_V}|{_V}{{2,}}{_C}|{_C}{_V}.)", "r1": f"^.*?{_V}{_C}", "r2": f"^.*?{_V}{_C}.*?{_V}{_C}"}


def _longest(suffixes: tuple[str, ...]) -> str:
    """The longest of the suffixes at a word's end: the leftmost place from which one goes to the end."""
    return "(?:" + "|".join(suffixes) + ")$"


_SPECIAL = ("amente", "mente", "idade", "idades", "iva", "ivo", "ivas", "ivos", "ira", "iras")
STANDARD = _longest((*DELETED, *REPLACED, *_SPECIAL))
#: What may stand before some suffixes, and goes with them.
BEFORE = {
    "amente": r"(?:(?:at)?iv|os|ic|ad)$",
    "mente": r"(?:ante|avel|ível)$",
    "idade": r"(?:abil|ic|iv)$",
    "iva": r"at$",
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used: nothing is copied where the planner moves the
    expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cut(word: Column, suffix: Column) -> Column:
    return F.left(word, F.length(word) - F.length(suffix))


def _without(word: Column, pattern: str, start: Column) -> Column:
    """The word without what the pattern finds at its end, as far as that lies behind ``start``. Of parts that are taken off
    one by one (``iv``, then ``at`` before it), those behind it go."""

    def cut(found: Column) -> Column:
        part = found.endswith("iv") & (F.length(word) - 2 >= start)
        return F.when(found == "", word).when(F.length(word) - F.length(found) >= start, _cut(word, found)).when(part, F.left(word, F.length(word) - 2)).otherwise(word)

    return _let(F.regexp_extract(word, pattern, 0), cut)


def _standard(word: Column, rv: Column, r1: Column, r2: Column) -> Column:
    """The word without its standard suffix, or null where there is none or it lies before its region."""

    def cut(found: Column, head: Column) -> Column:
        at = F.length(head)
        replaced = reduce(lambda c, kv: c.when(found == kv[0], F.concat(head, F.lit(kv[1]))), REPLACED.items(), F.when(F.lit(False), ""))
        return (
            F.when(found == "", None)
            .when(found == "amente", F.when(at >= r1, _without(head, BEFORE["amente"], r2)))
            .when(found.isin("ira", "iras"), F.when((at >= rv) & head.endswith("e"), F.concat(head, F.lit("ir"))))
            .when(at < r2, None)
            .when(found == "mente", _without(head, BEFORE["mente"], r2))
            .when(found.isin("idade", "idades"), _without(head, BEFORE["idade"], r2))
            .when(found.isin("iva", "ivo", "ivas", "ivos"), _without(head, BEFORE["iva"], r2))
            .when(found.isin(*REPLACED), replaced)
            .otherwise(head)
        )

    return _let(F.regexp_extract(word, STANDARD, 0), lambda found: _let(_cut(word, found), lambda head: cut(found, head)))


def _verbal(word: Column, rv: Column) -> Column:
    """The word without the longest verb suffix inside its region, or null."""
    return _let(F.regexp_extract(F.substring(word, rv + 1, F.length(word)), _longest(VERBAL), 0), lambda s: F.when(s != "", _cut(word, s)))


def _ended(left: Column, rv: Column) -> Column:
    """The last step: a final e, and the u or i before it, or a cedilla."""
    shorter = lambda n: F.left(left, F.length(left) - n)
    goes = left.rlike("[eéê]$") & (F.length(left) - 1 >= rv)
    second = left.rlike("(?:gu|ci).$") & (F.length(left) - 2 >= rv)
    return F.when(goes, F.when(second, shorter(2)).otherwise(shorter(1))).when(left.endswith("ç"), F.concat(shorter(1), F.lit("c"))).otherwise(left)


def stem(word: Column) -> Column:
    """The stem of a word in small letters; null of null."""

    def whole(w: Column, at: Column) -> Column:
        rv = at["rv"]
        residual = _let(F.regexp_extract(w, _longest(RESIDUAL), 0), lambda s: F.when((s != "") & (F.length(w) - F.length(s) >= rv), _cut(w, s)).otherwise(w))
        # after a change an i behind a c goes, otherwise a vowel or os
        after_c = lambda c: F.when(c.endswith("ci") & (F.length(c) - 1 >= rv), F.left(c, F.length(c) - 1)).otherwise(c)
        changed = F.coalesce(_standard(w, rv, at["r1"], at["r2"]), _verbal(w, rv))
        left = _let(changed, lambda c: F.when(c.isNotNull(), after_c(c)).otherwise(residual))
        return _let(left, lambda x: _ended(x, rv))

    tilde = F.replace(F.replace(word, F.lit("ã"), F.lit("a~")), F.lit("õ"), F.lit("o~"))
    regions = lambda w: F.struct(*(F.when(w.rlike(p), F.length(F.regexp_extract(w, p, 0))).otherwise(F.length(w)).alias(k) for k, p in REGIONS.items()))
    out = _let(tilde, lambda w: _let(regions(w), lambda at: whole(w, at)))
    return F.replace(F.replace(out, F.lit("a~"), F.lit("ã")), F.lit("o~"), F.lit("õ"))


def stems(terms: DataFrame, term: str = "term") -> DataFrame:
    """``term`` and ``stem`` of each row of ``terms``, of which one column holds small letters."""
    return terms.select(F.col(term).alias("term"), stem(F.col(term)).alias("stem"))
