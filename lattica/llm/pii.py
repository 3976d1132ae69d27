"""Personal information inside free text (problem 9).

Information-theoretic sanitisation.  What a term tells about protected entities is estimated from where both
stand together in the whole corpus; terms beyond a threshold of this *disclosure* are removed wherever they
occur and generalised to a placeholder of their type.  Disclosure is pointwise mutual information, normalised
so that 1 means never one without the other.

The entities to begin with are mail addresses, which tell themselves by their form.  *Names* have no form: a term
is one if it stands in documents together with addresses whose local part is made of it, or in naming slots
(after a title or initials), in enough of its occurrences.  *Numbers* and *street addresses* are candidates by
national forms; each candidate belongs to a term, its shape (digits as 9, or the street word), and a shape is
personal if names or mail addresses stand near it much more often than near any place of the corpus.  Shapes that are hardly
ever seen count as personal.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import small_enough, written

#: A term is removed from this disclosure on (normalised mutual information), or from this share of
#: its occurrences in naming slots on, given so many of those.  Common words stand in such slots (at the
#: end of a sentence in initials) for well under a twentieth of theirs.
DISCLOSURE, SLOT_SHARE, LEAST = 0.5, 0.12, 2
#: Characters around a number or street address in which a name or mail address stands near it, and the disclosure
#: below which a shape is harmless: halfway between no information and that of the loosest personal shapes.
NEAR, SHAPE_DISCLOSURE = 150, 0.3
#: A lexicon of more terms goes to the texts by a join instead of a broadcast.
MOST_TERMS = 200_000
KINDS = ("email", "phone", "id_number", "address", "name")

_AT = r"(?:[ \u00a0]?@[ \u00a0]?|[ \u00a0]?[\[({<]at[\])}>][ \u00a0]?|[ \u00a0](?:AT|at)[ \u00a0](?=[\w-]+(?:[ \u00a0](?:DOT|dot)[ \u00a0]|[ \u00a0]?[\[({]dot[\])}])))"
_DOT = r"(?:\.|[ \u00a0]?[\[({<]dot[\])}>][ \u00a0]?|[ \u00a0](?:DOT|dot)[ \u00a0])"
EMAIL = re.compile(rf"(?<![\w.+-])[A-Za-z0-9][\w.+-]*{_AT}[A-Za-z0-9][A-Za-z0-9-]*(?:{_DOT}[A-Za-z0-9][A-Za-z0-9-]*)*{_DOT}[A-Za-z]{{2,}}(?![\w-])", re.I)

# fixed values: national forms of telephone numbers
PHONE = re.compile(
    r"""(?<![\w./+-])(?<!\d[ ])(?:
      (?:\+|00)[1-9]\d{0,2}[ .-]?(?:\(0\)[ ]?)?\d{1,5}(?:[ .-]\d{2,9}){1,5}      # international
    | (?:1[ .-])?\(\d{3}\)[ ]?\d{3}[.-]\d{4} | (?:1-)?\d{3}-\d{3}-\d{4} | (?:1\.)?\d{3}\.\d{3}\.\d{4} | (?:1[ ])?\d{3}[ ]\d{3}[ -]\d{4}
    | [2-9]\d{2}[2-9]\d{6}                                                        # ten digits
    | \(0\d{1,4}\)[ ]?\d{3,4}[ ]\d{3,4} | 0\d(?:[ .]\d{2}){4} | 0\d{1,4}/\d{5,9} | 0\d{4}[ ]\d{6} | 0\d{2,3}[ ]\d{3,4}[ ]\d{3,4}
    )(?![\w/]|[.,-]\d)""",
    re.X,
)
# fixed values: forms of personal, identity card and passport numbers
ID_NUMBER = re.compile(
    r"""(?<![\w.+:/-])(?:
      [A-Za-z]{2}([ -]?)\d{2}\1\d{2}\1\d{2}\1[A-Da-d] | [A-Za-z]{2}\d{7}
    | [12]([ ]?)\d{2}\2\d{2}\2\d{2}\2\d{3}\2\d{3}\2\d{2} | \d{3}([ -])\d{2}\3\d{4} | \d{9}
    )(?![\w/-]|[.,]\d)""",
    re.X,
)
# fixed values: street words of the corpus' languages
_EN = r"(?:Street|Road|Lane|Avenue|Boulevard|Terrace|Mews|Close|Drive|Court|Crescent|Square|Place|Way|Grove|Gardens|STREET|ROAD|LANE|AVENUE|BOULEVARD|TERRACE|MEWS|CLOSE|DRIVE|COURT|CRESCENT|SQUARE|PLACE|WAY|GROVE|GARDENS|(?:St|ST)\b\.?|(?:Rd|Ave|Ln|Blvd|Sq|Pl|Ct|RD|AVE|LN|BLVD|SQ|PL|CT)\b(?:\.(?=[,;.]))?)"
_FR = r"(?:rue|impasse|avenue|boulevard|all[ée]e|chemin|place|quai|passage|cours|route|square)"
_ES = r"(?:calle|avenida|plaza|paseo|camino|carrera|ronda|traves[íi]a|callej[óo]n)"
_DE = r"(?:stra(?:ss|ß)e|str\.|gasse|platz|weg|allee|ring|damm|ufer|steig|markt)"
_UNIT = r"(?:(?:Flat|Unit|Apt\.?|Apartment|Suite|Wohnung|Appartement|Piso)[ ]\d+[A-Za-z]?(?:,[ ]|/|[ ]))?"
_WORD = r"[^\W\d_]+(?:['’][^\W\d_]+)?"
_CAP = r"(?-i:[A-ZÀ-Þ])[^\W\d_]*"
ADDRESS = re.compile(
    rf"""(?<![\w.-])(?:
      {_UNIT}\d{{1,4}}(?:[ ]?(?:bis|ter|quater))?,?[ ]{_FR}[ ](?:(?:de[ ]la[ ]|de[ ]l['’]|du[ ]|des[ ]|de[ ]|d['’]))?
        (?:(?:vieux|vieille|vieil|petite?|grande?|nouveau|nouvelle|haute?|basse?|saint|sainte|st|ste)[ -])?{_WORD}(?:-{_WORD})*
    | {_UNIT}\d{{1,4}}[A-Za-z]?[ ](?:{_CAP}(?:-{_CAP})?[ ]){{1,3}}?(?-i:{_EN})(?![\w-])
    | {_ES}[ ](?:(?:de[ ]los|de[ ]las|de[ ]la|del|de)[ ])?{_WORD}(?:[ ]{_CAP})?,?[ ]\d{{1,4}}(?:[ ]?[A-Za-z]\b)?
    | (?:[^\W\d_][\w-]*?{_DE}|{_CAP}[ -](?-i:Stra(?:ss|ß)e|Str\.|Gasse|Platz|Weg|Allee|Ring|Damm|Ufer|STRASSE|STR\.|GASSE|PLATZ|WEG|ALLEE|RING|DAMM|UFER))[ ]\d{{1,4}}(?:[ ]?[a-z]\b)?
    )(?![\w-])""",
    re.X | re.I,
)
# fixed values: titles before a name
TITLE = r"(?:Dr|Mr|Mrs|Ms|Miss|Prof|Frau|Herrn?|Mme|Mlle|Sra?|Do[ñn]a?)"
_PART = r"[^\W\d_]+"
_SLOT = re.compile(
    rf"\b{TITLE}\.?[ \u00a0]+({_PART}(?:-{_PART})?)|(?<![\w.])(?:[A-Z]\.[ -]?){{1,3}}[ \u00a0]?([A-Z]{_PART}(?:-[A-Z]{_PART})?)",
)
_TERM = re.compile(r"[^\W\d_]{3,}")
#: Two capitalised words in a row, perhaps with initials between: the first leads, the second trails.
_PAIR = re.compile(r"\b([A-ZÀ-Þ][^\W\d_]+)(?=[ \u00a0](?:[A-Z]\.[ \u00a0]?){0,2}([A-ZÀ-Þ][^\W\d_]+))")


# vector patterns that every text with a finding of the kind matches (and some others): only texts that
# do are searched one by one
_SP = r"[ \x{00a0}]"
_MAYBE = {
    "email": rf"(?i)@|[\[({{<]at[\])}}>]|{_SP}at{_SP}[\w-]+(?:{_SP}dot{_SP}|{_SP}?[\[({{<]dot[\])}}>])",
    "phone": r"\+[1-9]|00[1-9]\d*[ .(-]|\(\d{2,5}\)|\d{3}[-.]\d{3}[-.]\d{4}|\d{3} \d{3}[ -]\d{4}|[2-9]\d{2}[2-9]\d{6}|0\d(?:[ .]\d\d){4}|0\d{1,4}/\d{5}|0\d{4} \d{6}|0\d{2,3} \d{3,4} \d{3,4}",
    "id_number": r"[A-Za-z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-Da-d]\b|[A-Za-z]{2}\d{7}\b|\b[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}\b|\b\d{3}[ -]\d{2}[ -]\d{4}\b|\b\d{9}\b",
    "address": r"\d[A-Za-z]? (?:[A-Z\x{00c0}-\x{00de}][\pL]*(?:-[\pL]+)? ){1,3}" + _EN.replace(r"(?:\.(?=[,;.]))?", "").replace(r"\.?)", ")")
    + rf"|(?i:\d(?: ?(?:bis|ter|quater))?,? {_FR} )|(?i:{_ES} [^\d\n]{{1,60}}\d)|(?i:{_DE} \d)",
}
_SLOTTED = rf"\b{TITLE}\.?{_SP}|\b[A-Z]\.[ -]?(?:[A-Z]\.[ -]?)*{_SP}?[A-Z\x{{00c0}}-\x{{00de}}][\pL]"
_NO_LETTERS = r"[^\pL]+"


def _words(texts: pa.Array) -> pa.ListArray:
    """The words of every text, in lower case."""
    return pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), _NO_LETTERS)


def _emails(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in EMAIL.finditer(text)]


def _term_counts(text: str) -> tuple[set[str], Counter, Counter, Counter]:
    """(terms of the text that an address of it is made of, occurrences in naming slots, and as first and
    as second of two capitalised words); without letter case, and without the addresses themselves."""
    spans = _emails(text)
    parts: set[str] = set()
    if spans:
        keep, at = [], 0
        for a, z in spans:
            keep.append(text[at:a])
            local = re.split(r"[^\w.+-]", text[a:z], maxsplit=1)[0].split("+")[0]
            parts.update(x.lower() for x in _TERM.findall(local))
            at = z
        text = " ".join([*keep, text[at:]])
    told: set[str] = set()
    if parts:
        words = set(_TERM.findall(text.lower()))
        for p in parts:
            if p in words:
                told.add(p)
            elif p[1:] in words and len(p) > 4:  # an initial before the family name
                told.add(p[1:])
    slots: Counter = Counter()
    for m in _SLOT.finditer(text):
        slots.update(_TERM.findall((m[1] or m[2]).lower()))
    lead, trail = Counter(), Counter()
    for a, b in _PAIR.findall(text):
        lead[a.lower()] += 1
        trail[b.lower()] += 1
    return told, slots, lead, trail


COUNTS = ("occurrences", "told", "slots", "lead", "trail")


def disclosure(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, occurrences, told, slots, lead, trail, npmi): of every term that ever stands with an entity
    made of it or in a naming slot, how strongly it tells it.  ``occurrences`` counts the words of all
    texts, in vector operations; texts with an address or a naming slot are searched one by one for the
    rest.  Counts are map-side sums per task, then one shuffle of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [Counter() for _ in COUNTS]

        def out() -> pa.RecordBatch:
            terms = list(counters[0])
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array([c[t] for t in terms], pa.int64()) for c in counters]], names=["term", *COUNTS])

        for b in batches:
            texts = b.column(0)
            seen = pc.value_counts(_words(texts).flatten())
            for w, n in zip(seen.field(0).to_pylist(), seen.field(1).to_pylist()):
                if len(w) > 2:
                    counters[0][w] += n
            some = pc.fill_null(pc.or_(pc.match_substring_regex(texts, _MAYBE["email"]), pc.match_substring_regex(texts, _SLOTTED)), False)
            for t in texts.filter(some).to_pylist():
                for c, x in zip(counters[1:], _term_counts(t)):
                    c.update(x)
            if len(counters[0]) > 500_000:
                yield out()
                for c in counters:
                    c.clear()
        if counters[0]:
            yield out()

    per_task = docs.select(F.col(text)).mapInArrow(run, "term string, " + ", ".join(f"{c} bigint" for c in COUNTS))
    sums = per_task.groupBy("term").agg(*[F.sum(c).alias(c) for c in COUNTS]).where("told > 0 OR slots > 0")
    total = F.lit(max(docs.count(), 2)).cast("double")
    # every told document holds both the term and the entity, so the joint share and the entity's own
    # share are both told / total: pmi = log(total / documents with the term), normalised by
    # -log(told / total).  Occurrences bound those documents from above, so the disclosure from below.
    npmi = F.when(F.col("told") > 0, F.log(total / F.col("occurrences")) / F.greatest(F.log(total / F.col("told")), F.lit(1e-9)))
    return sums.withColumn("npmi", npmi)


def names_lexicon(terms: DataFrame) -> DataFrame:
    """(term, given) of the terms beyond the disclosure threshold: told by addresses in some share of
    their occurrences, or often in naming slots.  ``given``: the term rather leads a name than ends it."""
    told = (F.col("npmi") >= DISCLOSURE) & (F.col("told") >= 0.02 * F.col("occurrences"))
    slot = (F.col("slots") >= SLOT_SHARE * F.col("occurrences")) & (F.col("slots") >= LEAST)
    return terms.where(told | slot).select("term", ((F.col("lead") >= 2) & (2 * F.col("lead") >= 3 * F.col("trail"))).alias("given"))


_TOKEN = re.compile(r"[^\W\d_]{3,}")
_BETWEEN_INITIAL = re.compile(r"[ \u00a0](?:[A-Za-z]\.[ \u00a0]?){1,2}\Z")
_BEFORE_INITIAL = re.compile(r"(?<![\w.])(?:[A-Za-z]\.[ \u00a0]?){1,3}\Z")
# fixed values: function words that tell French from the other languages, around the title "M."
_FRENCH = re.compile(r"\b(?:le|les|du|des|au|aux|est|porte|num[ée]ro|dossier|et|une?|avec|pour|chez|sur|par)\b", re.I)
_NOT_FRENCH = re.compile(r"\b(?:el|los|del|muestra|tiene|n[úu]mero|una|y|al|the|of|and|for|to|der|die|das|und|an)\b", re.I)


def _is_title(text: str, start: int, end: int) -> bool:
    """Whether ``M.`` before a name is the French title: after a French word, in French words."""
    if text[start:end].strip() != "M." or not re.search(r"\b(?:de|à|par|pour|chez|avec|et|que)[ \u00a0]\Z", text[max(0, start - 6) : start]):
        return False
    around = text[max(0, start - 40) : start] + " " + text[end : end + 50]
    return len(_FRENCH.findall(around)) > len(_NOT_FRENCH.findall(around))


def _names(text: str, terms: dict[str, bool], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of names: given name, perhaps a middle initial, and family name, either of them hyphened;
    initials and family name; a family name alone; "Family, Given".  After a family name a blank ends the
    name, whatever follows."""
    hits = []
    for m in _TOKEN.finditer(text):
        given = terms.get(m.group().lower())
        if given is not None and not any(a < m.end() and m.start() < z for a, z in taken):
            hits.append((m.start(), m.end(), given))
    units: list[list] = []  # start, end, given: parts joined by hyphens
    for a, z, given in hits:
        if units and text[units[-1][1] : a] == "-":
            units[-1][1] = z
        else:
            units.append([a, z, given])
    names: list[list] = []  # start, end, parts, given of the last part
    for a, z, given in units:
        if names and names[-1][3]:
            gap = text[names[-1][1] : a]
            if gap in (" ", "\u00a0") or (len(gap) < 8 and _BETWEEN_INITIAL.match(gap)):
                names[-1][1:] = [z, names[-1][2] + 1, given]
                continue
        names.append([a, z, 1, given])
    out: list[tuple[int, int]] = []
    i = 0
    while i < len(names):
        a, z, n, given = names[i]
        before = None if n > 1 else _BEFORE_INITIAL.search(text, max(0, a - 12), a)
        if before and _is_title(text, before.start(), a):
            before = None
        after = names[i + 1] if i + 1 < len(names) else None
        if n == 1 and not given and not before and after and after[2] == 1 and after[3] and text[z : after[0]] == ", ":
            z = after[1]
            i += 1
        out.append((before.start() if before else a, z))
        i += 1
    return out


def find_spans(text: str | None, terms: dict[str, bool], kinds: frozenset[str] | set[str] = frozenset(KINDS)) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what a text tells, in order, without overlaps: mail addresses first, then
    street addresses, identity and telephone numbers, and names outside all of them.  ``terms``: the
    lexicon, true for given names; ``kinds``: those that the text may hold."""
    if not text:
        return []
    found = [(a, z, "email") for a, z in _emails(text)] if "email" in kinds else []
    free = lambda a, z: not any(x < z and a < y for x, y, _ in found)
    for kind, pattern in (("address", ADDRESS), ("id_number", ID_NUMBER), ("phone", PHONE)):
        if kind in kinds:
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if free(*m.span())]
    if "name" in kinds:
        found += [(a, z, "name") for a, z in _names(text, terms, [(a, z) for a, z, _ in found])]
    return sorted(found)


def spans_of(texts: pa.Array, lexicon: dict[str, bool]) -> dict[int, list[tuple[int, int, str]]]:
    """The findings of each text of a batch, by its place; vector operations choose the texts and the
    kinds to search for."""
    may: dict[int, set[str]] = {}
    for kind, pattern in _MAYBE.items():
        for i in pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, pattern), False)).to_pylist():
            may.setdefault(i, set()).add(kind)
    words = _words(texts)
    hit = pc.is_in(words.flatten(), value_set=pa.array(list(lexicon), pa.string()))
    for i in pc.unique(pc.list_parent_indices(words).filter(hit)).to_pylist():
        may.setdefault(i, set()).add("name")
    chosen = sorted(may)
    found = zip(chosen, texts.take(pa.array(chosen, pa.int64())).to_pylist())
    return {i: spans for i, t in found if (spans := find_spans(t, lexicon, may[i]))}


def _with_terms(docs: DataFrame, doc_id: str, text: str, lexicon: DataFrame) -> tuple[DataFrame, dict[str, bool] | None]:
    """The documents, and the lexicon as a table in memory if it is bounded; else each document with the
    terms of the lexicon that it holds, found by a join on the term."""
    lexicon = written(lexicon, "lexicon")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    if lexicon.limit(MOST_TERMS + 1).count() <= MOST_TERMS:
        return rows, {r[0]: r[1] for r in lexicon.collect()}
    own = rows.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("term"))
    held = own.join(lexicon, "term").groupBy("doc_id").agg(F.collect_list(F.struct("term", "given")).alias("terms"))  # a text's own terms
    return rows.join(held, "doc_id", "left"), None


def _lexicon_of(batch: pa.RecordBatch, terms: dict[str, bool] | None) -> dict[str, bool]:
    """The lexicon, or the terms of it that the batch's texts hold."""
    if terms is not None:
        return terms
    return {t["term"]: t["given"] for own in batch.column(2).to_pylist() for t in own or ()}


_STREET = re.compile(rf"{_EN}|{_FR}|{_ES}|{_DE}", re.I)


def shape_of(kind: str, text: str) -> str | None:
    """The term whose disclosure decides on a candidate: for numbers their form with digits as 9 and letters as they
    stand, for street addresses the street word; None for kinds that are decided otherwise."""
    if kind in ("phone", "id_number"):
        return f"{kind} " + re.sub(r"\d", "9", text)
    if kind == "address":
        words = [m.group().lower().rstrip(".") for m in _STREET.finditer(text)]
        return f"{kind} " + (words[-1] if words else "")
    return None


def _near(spans: list[tuple[int, int, str]], length: int) -> list[tuple[int, int]]:
    """The parts of a text, without overlaps, that lie near its names and mail addresses."""
    parts: list[tuple[int, int]] = []
    for a, z, kind in spans:
        if kind in ("name", "email"):
            a, z = max(0, a - NEAR), min(length, z + NEAR)
            if parts and a <= parts[-1][1]:
                parts[-1] = parts[-1][0], max(z, parts[-1][1])
            else:
                parts.append((a, z))
    return parts


def candidates(docs: DataFrame, lexicon: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pii_kind, pii_text, shape, n, near, chars, covered): each candidate of a document once, with how often
    it occurs there and how often near a name or mail address; and rows without a document with the characters of texts and
    those near such."""
    rows, terms = _with_terms(docs, doc_id, text, lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, covered = b.column(1), 0
            found: dict[tuple[int, str, str], list[int]] = {}
            for i, spans in spans_of(texts, _lexicon_of(b, terms)).items():
                doc, t = b.column(0)[i].as_py(), texts[i].as_py()
                parts = _near(spans, len(t))
                covered += sum(z - a for a, z in parts)
                for a, z, kind in spans:
                    got = found.setdefault((doc, kind, t[a:z]), [0, 0])
                    got[0] += 1
                    got[1] += any(x < z and a < y for x, y in parts)
            out = [(*key, shape_of(key[1], key[2]), n, near, None, None) for key, (n, near) in sorted(found.items(), key=lambda kv: str(kv[0]))]
            out.append((None, None, None, None, None, None, pc.sum(pc.utf8_length(texts)).as_py() or 0, covered))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["doc_id", "pii_kind", "pii_text", "shape", "n", "near", "chars", "covered"])

    return rows.mapInArrow(run, "doc_id bigint, pii_kind string, pii_text string, shape string, n bigint, near bigint, chars bigint, covered bigint")


def shapes(found: DataFrame) -> DataFrame:
    """(shape, n, near, npmi) of the shapes among written :func:`candidates`.  Two occurrences near names are added to
    each, so that rare shapes count as personal."""
    base = found.agg((F.coalesce(F.sum("covered"), F.lit(0)) / F.greatest(F.sum("chars"), F.lit(1))).alias("base"))
    sums = found.where("shape IS NOT NULL").groupBy("shape").agg(F.sum("n").alias("n"), F.sum("near").alias("near"))
    p0 = F.least(F.greatest(F.coalesce("base", F.lit(0.0)), F.lit(1e-9)), F.lit(0.999))
    share = (F.col("near") + 2) / (F.col("n") + 2)
    return sums.crossJoin(F.broadcast(base)).select("shape", "n", "near", (F.log(share / p0) / -F.log(p0)).alias("npmi"))  # one row


def harmless(found: DataFrame) -> DataFrame:
    """(shape) of the shapes that tell no person: below the disclosure threshold."""
    return shapes(found).where(F.col("npmi") < SHAPE_DISCLOSURE).select("shape")


def find_pii(docs: DataFrame, lexicon: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pii_kind, pii_text), once per document, kind and text as it stands.  Null and empty texts
    tell nothing; copies are reported each."""
    found = written(candidates(docs, lexicon, doc_id, text), "candidates")
    rest, _ = small_enough(written(harmless(found), "harmless"))
    return found.where("doc_id IS NOT NULL").join(rest, "shape", "left_anti").select("doc_id", "pii_kind", "pii_text")


def sanitise(docs: DataFrame, lexicon: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, removed): the texts with every finding replaced by its typed placeholder, such as
    ``[EMAIL]``, and their number.  The rest of the text stays; null stays null.  At most MOST_TERMS harmless
    shapes are kept in memory; beyond that ValueError."""
    lexicon = written(lexicon, "lexicon")
    shapes_left = harmless(written(candidates(docs, lexicon, doc_id, text), "candidates")).limit(MOST_TERMS + 1).collect()
    if len(shapes_left) > MOST_TERMS:
        raise ValueError("too many shapes of numbers to keep in memory")
    rest = {r[0] for r in shapes_left}
    rows, terms = _with_terms(docs, doc_id, text, lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, n = b.column(1).to_pylist(), [0] * b.num_rows
            for i, spans in spans_of(b.column(1), _lexicon_of(b, terms)).items():
                t, parts, at = out[i], [], 0
                for a, z, kind in spans:
                    if shape_of(kind, t[a:z]) not in rest:
                        parts += [t[at:a], f"[{kind.upper()}]"]
                        at, n[i] = z, n[i] + 1
                out[i] = "".join([*parts, t[at:]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(n, pa.int32())], names=["doc_id", "text", "removed"])

    return rows.mapInArrow(run, "doc_id bigint, text string, removed int")


def corpus_lexicon(docs: DataFrame, text: str = "text") -> DataFrame:
    return names_lexicon(disclosure(docs, text))


__all__ = ["candidates", "corpus_lexicon", "disclosure", "find_pii", "find_spans", "names_lexicon", "sanitise", "shapes"]
