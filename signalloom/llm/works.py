"""Matching records of works across sources without shared keys.

Collective graph linkage: every record gets blocking keys from its partial
attributes (ids, title, title with one word left out, title with year or author,
pieces of the abstract).  In a block each record meets each, however many there are, and
the pairs within reach go on: those whose score could be accepted with all help of their
neighbours.  In large blocks they are told by a bound of the score that is never
too low, made from bitmaps of both records, tile by tile of the block.  Pairs
out of reach go on as well where they share a key and a neighbour within reach of
both: they speak against it.  So the size of a block decides how its pairs are
found, never which.  The pairs are
scored on all attributes and refined by their neighbours' scores until stable
(each round changes a score by half the change of its neighbours at most, so
this ends); strong edges, and the best weak edge of records without a strong
one, join records into works.

The result is one row per record with its work, the number of records of the work, and
how sure it is: the logistic of the best score that ties the record to the work,
1 for a record that is alone or equal to another one.  A match is as sure as
the less sure of its two records.

Defined results: records without any usable attribute match nothing; equal
records are collapsed to one node first, so copies cost no comparisons; nulls
say nothing for or against a match.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.llm.graph import all_pairs, components, join_skewed, paired, spans, tiled, whole_tiles
from signalloom.llm.storage import written

RECORD = "rec_id long, source string, node long, arxiv string, doi string, title string, words array<int>, cut boolean, abstract array<int>, people array<int>, families array<int>, year int, keys array<long>"
ACCEPT = 2.0
STABLE = 0.05
#: Scores count between FLOOR and -FLOOR in the propagation; alike abstracts add so much at most.
FLOOR, MOST_BY_ABSTRACT = -6.0, 5.0
#: The least score by itself with which a pair may still be accepted: neighbours add half of -FLOOR at most.
REACH = ACCEPT + FLOOR / 2 - 1e-6
#: Pairs of blocks of at most SMALL records are scored at once; those of larger ones where a bound of the score is within reach. The result is the same.
SMALL = 4
#: Five-word pieces of an abstract by which it is looked up.
ABSTRACT_KEYS = 8
# Words that carry no meaning in titles, and labels that feeds put around them.
STOP = frozenset("a an the on and of with its for in to by at as is how".split())
LABEL = re.compile(r"^(?:\s*[\[(]?(?:research article|technical note|original article|article|preprint|paper|review|letter|full paper|extended abstract|short paper|report)\s*[\])]?(?<=[\])])\s*|\s*(?:research article|technical note|original article|article|preprint|paper|review|letter|full paper|extended abstract|short paper|report)\s*[:.\-–]\s*)+|\s*[\(\[]\s*(?:preprint|v\d+|extended(?: version)?|poster|abstract only|working paper|submitted|accepted)\s*[\)\]]\s*$", re.I)
PARTICLES = frozenset("van von de der den el al la le di da dos del bin ibn".split())
NOISE = frozenset("dr prof mr mrs ms phd md jr sr ii iii iv ed eds sir".split())
# Words by which a later work of the same title is told.
SEQUEL = r"\b(?:(?:part )?(?:ii|iii|iv|v|two|three|2|3|4)|revisited|sequel|continued|followup|follow up|reconsidered|again|(?:ten|five|two) years later)$"
#: Ends every title that SEQUEL may tell from another, also where the other one is its beginning up to the middle of a word.
ENDS_AS_SEQUEL = re.compile(SEQUEL.removeprefix(r"\b"))


_MARKS = re.compile(r"[<&${}\\]")


def folded(text: str) -> str:
    """Compatibility forms folded, accents and case dropped, mark-up removed."""
    if _MARKS.search(text):
        text = re.sub(r"</?[a-zA-Z]{1,6}>|&(?:amp|lt|gt|nbsp|quot);|[${}\\]", " ", text)
    if text.isascii():
        return text.casefold()
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c)).replace("ß", "ss").replace("­", "").casefold()


def title_words(title: str) -> tuple[list[str], bool]:
    """Meaningful words of a title and whether it was cut."""
    t = LABEL.sub(" ", title or "")
    cut = bool(re.search(r"(?:…|\.\.\.)\s*$", t))
    t = folded(re.sub(r"\w+(?:…|\.\.\.)\s*$", "", t) if cut else t)
    t = re.sub(r"[‐-―\-]", " ", t)
    return [w for w in re.findall(r"\w+", t) if w not in STOP], cut


def clean_doi(doi: str | None) -> str | None:
    m = re.search(r"10\.\d{4,9}/\S+", unquote(unquote(doi or "")).casefold())
    return m[0].rstrip(".,;)]}/ ") if m else None


def clean_arxiv(value: str | None, doi: str | None) -> str | None:
    """arXiv id without version, from its own field or from an arXiv DOI."""
    for s in (value, doi if doi and "arxiv" in doi else None):
        if s and (m := re.search(r"(\d{4}\.\d{4,5}|[a-z\-]+(?:\.[a-z]{2})?/\d{7})(?:v\d+)?\s*$", s.casefold().strip().rstrip("/"))):
            return m[1]
    return None


def name_parts(name: str) -> tuple[list[str], list[str]]:
    """(all long words, words of the likely family name)."""
    name = re.sub(r"[\"“”(\[].*?[\"“”)\]]", " ", name)
    parts = [re.findall(r"[^\W\d_]+", folded(p).replace("'", "").replace("’", "")) for p in name.split(",")]
    parts = [[w for w in p if w not in NOISE] for p in parts]
    parts = [p for p in parts if p]
    if not parts:
        return [], []
    flat = [w for p in parts for w in p if w not in PARTICLES]
    long = [w for w in flat if len(w) > 2]
    if len(parts) > 1:
        fam = [w for w in parts[0] if w not in PARTICLES]
    else:
        ws = [w for w in parts[0] if w not in PARTICLES]
        tail = re.split(r"[\s.]+", folded(name).strip(" *†‡0123456789"))[-1]
        fam = [w for w in re.findall(r"[^\W\d_]+", tail.replace("'", "").replace("’", "")) if len(w) > 2] or ws[:1]
    return long, fam


@lru_cache(maxsize=1 << 17)
def _grams_of(w: str) -> tuple[int, ...]:
    return tuple(xxhash.xxh32_intdigest(w[i : i + 3]) - (1 << 31) for i in range(max(1, len(w) - 2)))


def _grams(words: list[str]) -> list[int]:
    return sorted({g for w in words for g in _grams_of(w)})


class _Hashes(dict):
    """Hash of each word, made once per worker; emptied when it has grown too large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()
_U = np.uint64


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n words in a row."""
    out = np.zeros(max(0, len(h) - n + 1), _U)
    for k in range(n):
        out = out * _U(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    out = (out ^ (out >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return out ^ (out >> _U(32))


def _least(h: np.ndarray, n: int) -> list[int]:
    """The n smallest different hashes."""
    return np.unique(h)[:n].tolist()


_WORD = re.compile(r"\w+")


def _h(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode()) - (1 << 63)


#: The last two bits of a key say what it is: an id, a title with a word left out, a piece of an abstract, or another key.
ID_KEY, LEFT_OUT_KEY, PIECE_KEY = 1, 2, 3


def _key(kind: int, *parts: object) -> int:
    return (_h(*parts) & ~3) | kind


def _year(*values: object) -> int | None:
    for v in values:
        if isinstance(v, int) and 1900 < v < 2100:
            return v
        if isinstance(v, str):
            if m := re.search(r"(?<!\d)((?:19|20)\d\d)(?!\d)", v):
                return int(m[1])
            if m := re.match(r"\s*((?:19|20)\d\d)(?:0[1-9]|1[0-2])[0-3]\d", v):
                return int(m[1])
            if m := re.match(r"\s*\d\d?-[A-Za-z]{3}-(\d\d)$", v):
                return 2000 + int(m[1])
            if m := re.match(r"\s*(\d{10})(?:\d{3})?\s*$", v):
                return 1970 + int(int(m[1]) // 31_556_952)
    return None


def record_features(title: str | None, abstract: str | None, authors: list | None, year: int | None, date: str | None, doi: str | None, arxiv: str | None) -> tuple:
    doi = clean_doi(doi)
    ax = clean_arxiv(arxiv, doi)
    if doi and "arxiv" in doi:
        doi = None
    words, cut = title_words(title or "")
    text = [w for w in _WORD.findall(folded(abstract or "")) if len(w) > 1]
    h = np.fromiter(map(_HASHES.__getitem__, text), _U, len(text))
    twos = np.unique((_runs(h, 2) >> _U(32)).astype(np.uint32))
    grams = twos.view(np.int32).tolist()
    people, fams = [], []
    for name in authors or []:
        if name and name.strip():
            long, fam = name_parts(name)
            people += long
            fams += fam
    y = _year(year, date)
    keys = set()
    if ax:
        keys.add(_key(ID_KEY, "ax", ax))
        if (m := re.match(r"(\d\d)\d\d\.", ax)) and y is None:
            y = 2000 + int(m[1])
    if doi:
        keys.add(_key(ID_KEY, "doi", doi))
        if y is None:
            y = _year(doi)
    if words:
        t = " ".join(sorted(words))
        keys.add(_key(0, "t", t))
        if y:
            keys |= {_key(0, "ty", t, y), _key(0, "ty", t, y + 1)}
        for f in fams or people:
            keys.add(_key(0, "tf", t, f))
        if len(words) > 3:
            for i in range(len(words)):
                keys.add(_key(LEFT_OUT_KEY, "t-", " ".join(sorted(words[:i] + words[i + 1 :]))))
        if len(words) >= 4:
            keys.add(_key(0, "tp", " ".join(words[:4]), (fams or people or [""])[0]))
    if fams and words:
        keys.add(_key(0, "fw", " ".join(sorted(set(fams))), words[0]))
        keys.add(_key(0, "fl", " ".join(sorted(set(fams))), words[-1]))
    if len(grams) >= 6:
        mixed = twos.astype(_U) * _U(0x9E3779B97F4A7C15)
        for x in _least(mixed ^ (mixed >> _U(29)), 3):
            keys.add(_key(PIECE_KEY, "ab", x, words[0] if words else ""))
    # Pieces of the abstract that do not depend on the title.
    # Of a text of which a share p is left, one of its n smallest hashes is the smallest of the rest in 1 - (1 - p)^n of the cases.
    for x in _least(_runs(h, 5), ABSTRACT_KEYS):
        keys.add((x - (1 << 63)) | PIECE_KEY)
    return ax, doi, " ".join(words), sorted({xxhash.xxh32_intdigest(w) - (1 << 31) for w in words}), cut, grams, _grams(people), _grams(fams), y, sorted(keys)


def prepare(records: DataFrame) -> DataFrame:
    """Features of rec_id, source, title, abstract, authors, year, date, doi, arxiv; node is equal for equal records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int64())]
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(2, 9)]
            rows = [record_features(*r) for r in zip(*cols)]
            node = pa.array([_h(*r) for r in rows], pa.int64())
            out = [pa.array([r[i] for r in rows], types[i]) for i in range(10)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), node, *out], names)

    return records.select(F.col("rec_id").cast("long"), "source", "title", "abstract", "authors", F.col("year").cast("int"), "date", "doi", "arxiv").mapInArrow(run, RECORD)


def _share(a: Column, b: Column) -> Column:
    """Common elements over the smaller set; null where either is empty."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small)


#: Of a record in a large block: bits of its title's words, trigrams and letters, families, people and abstract, then its ids, numbers and whether its title may be a sequel's.
_BITS = {"words": slice(0, 1), "title": slice(1, 5), "letters": slice(5, 9), "families": slice(9, 11), "people": slice(11, 13), "abstract": slice(13, 29)}
BRIEF = np.dtype([("bits", "<u8", 29), ("arxiv", "<u8"), ("doi", "<u8"), *[(c, "<i4") for c in ("year", "length", "words", "families", "people", "abstract")], ("sequel", "<i8")])


def _bitmap(owner: np.ndarray, hashes: np.ndarray, rows: int, words: int) -> np.ndarray:
    set_ = np.zeros((rows, 64 * words), bool)
    set_[owner, hashes % (64 * words)] = True
    return np.packbits(set_, axis=1).view(_U)


def _runs_of(chars: np.ndarray, number: np.ndarray) -> np.ndarray:
    return ((chars * _U(0x9E3779B97F4A7C15)) ^ ((number + _U(1)) * _U(0xD6E8FEB86659FD93))) >> _U(40)


def brief(nodes: DataFrame) -> DataFrame:
    """node, brief (one BRIEF): enough for a bound of the score of any two records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            out = np.zeros(n, BRIEF)
            each = np.arange(n)
            for c in ("words", "families", "people", "abstract"):
                v = b.column(c)
                out[c] = sizes = v.value_lengths().to_numpy()
                out["bits"][:, _BITS[c]] = _bitmap(np.repeat(each, sizes), v.flatten().to_numpy().view(np.uint32), n, out["bits"][:, _BITS[c]].shape[1])
            titles = b.column("title").to_pylist()
            out["length"] = sizes = np.fromiter(map(len, titles), np.int64, n)
            chars = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), "<u4").astype(_U)
            owner = np.repeat(each, sizes)
            # Each letter with its running number in its title.
            order = np.lexsort((chars, owner))
            o, c = owner[order], chars[order]
            new = np.ones(len(c), bool)
            new[1:] = (o[1:] != o[:-1]) | (c[1:] != c[:-1])
            at = np.arange(len(c))
            number = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(_U)
            out["bits"][:, _BITS["letters"]] = _bitmap(o, _runs_of(c, number), n, 4)
            if len(chars) > 2:
                one = owner[2:] == owner[:-2]
                out["bits"][:, _BITS["title"]] = _bitmap(owner[2:][one], (_runs(chars, 3) >> _U(32))[one], n, 4)
            for c in ("arxiv", "doi"):
                out[c] = [xxhash.xxh64_intdigest(x) | 1 if x is not None else 0 for x in b.column(c).to_pylist()]
            out["year"] = b.column("year").fill_null(0).to_numpy()
            out["sequel"] = [ENDS_AS_SEQUEL.search(t) is not None for t in titles]
            data = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * BRIEF.itemsize).astype(np.int32)), pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("node"), data], ["node", "brief"])

    return nodes.select("node", "arxiv", "doi", "title", "words", "abstract", "people", "families", "year").mapInArrow(run, "node long, brief binary")


def _at_most(rows: np.ndarray) -> tuple:
    """(before, whole): upper bounds of the score of two records before their abstracts, and what the abstracts add, as functions of their rows."""
    bits = {c: [np.ascontiguousarray(rows["bits"][:, k]) for k in range(s.start, s.stop)] for c, s in _BITS.items()}
    f = {c: np.ascontiguousarray(rows[c]) for c in BRIEF.names[1:]}
    eps = 1e-6

    def lacks(c, a, b):
        """So many elements of a at least are not in b."""
        return sum(np.bitwise_count(x[a] & ~x[b]).astype(np.int32) for x in bits[c])

    def share(c, a, b):
        """As _share, at most; 0 for empty sets."""
        na, nb = f[c][a], f[c][b]
        return np.minimum(na - lacks(c, a, b), nb - lacks(c, b, a)) / np.maximum(np.minimum(na, nb), 1)

    def before(a, b):
        words = share("words", a, b)
        longest = np.maximum(np.maximum(f["length"][a], f["length"][b]), 1)
        # An edit takes three trigrams at most, and one letter.
        edits = np.maximum(np.maximum(lacks("title", a, b), lacks("title", b, a)) / 3, np.maximum(lacks("letters", a, b), lacks("letters", b, a)))
        fuzz = 1 - edits / longest + eps
        words = words + eps
        t = np.where(fuzz >= 1, 3.0, np.where(fuzz >= 0.9, 2.5, np.where(words >= 0.85, 1.5, np.where((words >= 0.8) | (fuzz >= 0.8), 1.0, np.where(words >= 0.6, -2.0, np.where(f["sequel"][a] | f["sequel"][b], -6.0, -7.0))))))
        t = np.where((f["words"][a] > 0) & (f["words"][b] > 0), t, 0.0)
        fam, ppl = share("families", a, b) + eps, share("people", a, b) + eps
        close = np.maximum(fam, np.where(ppl >= 0.75, ppl, 0.0))
        known = (np.minimum(f["families"][a], f["families"][b]) > 0) | (np.minimum(f["people"][a], f["people"][b]) > 0)
        w = np.where(known, np.where(close >= 0.8, 2.5, np.where(close >= 0.5, 1.0, np.where(close >= 0.3, -1.5, -4.0))), 0.0)
        gap = np.abs(f["year"][a] - f["year"][b])
        y = np.where((f["year"][a] == 0) | (f["year"][b] == 0), 0.0, np.where(gap == 0, 1.0, np.where(gap == 1, 0.3, np.where(gap == 2, -1.0, -3.0))))
        ids = 0.0
        for c, same, other in (("arxiv", 6.0, -6.0), ("doi", 4.0, -3.0)):
            ids = ids + np.where((f[c][a] == 0) | (f[c][b] == 0), 0.0, np.where(f[c][a] == f[c][b], same, other))
        return t + w + ids + y - 1.0

    def abstracts(a, b):
        ab = share("abstract", a, b) + eps
        enough = np.minimum(f["abstract"][a], f["abstract"][b]) >= 8
        return np.where(~enough, 0.0, np.where(ab >= 0.75, MOST_BY_ABSTRACT, np.where(ab >= 0.5, 3.5, np.where(ab >= 0.35, 0.0, -5.0))))

    return before, abstracts


def candidates(nodes: DataFrame) -> DataFrame:
    """a, b: all pairs that share a key and are within reach, and some others; of large blocks those whose bound is within reach."""
    keys = nodes.select("node", F.explode("keys").alias("key"))
    sizes = written(keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).where("lo <> hi").drop("lo", "hi"), "blocks")
    small = keys.join(sizes.where(F.col("n") <= SMALL).select("key"), "key").groupBy("key").agg(F.collect_list("node").alias("all"))
    each = small.select(F.explode(F.flatten(F.transform("all", lambda x: F.transform(F.filter("all", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("e")).select("e.a", "e.b")
    large = sizes.where(F.col("n") > SMALL).withColumn("c", F.col("n"))
    members = written(join_skewed(keys, large, ["key"], "c"), "members")
    # The widest rows are made for the members of large blocks only, and once each.
    briefs = brief(nodes.join(members.select("node").distinct(), "node", "left_semi"))
    tiles = tiled(members.join(briefs, "node"), "key", "n", "node").drop("n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in whole_tiles(batches, "key"):
            v = t.column("brief").combine_chunks()
            v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
            start = np.frombuffer(v.buffers()[1], np.int32)[v.offset]
            before, abstracts = _at_most(np.frombuffer(v.buffers()[2], BRIEF, t.num_rows, int(start)))
            node = t.column("node").to_numpy()

            def alike(a, b):
                most = before(a, b)
                keep = most + MOST_BY_ABSTRACT >= REACH
                some = np.flatnonzero(keep)
                x, y = (np.full(len(some), a), some + b.start) if isinstance(b, slice) else (a[some], b[some])
                keep[some] = most[some] + abstracts(x, y) >= REACH
                return keep

            for a, b in all_pairs(*spans(first, t), alike):
                x, y = node[a], node[b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return written(each.unionByName(tiles.mapInArrow(run, "a long, b long")).distinct(), "edges")


def wedges(near: DataFrame) -> DataFrame:
    """c, x, y: every node c with each two of its neighbours x < y by the edges a, b; hubs are spread over many tasks."""
    arcs = near.select(F.col("a").alias("c"), F.col("b").alias("v")).unionByName(near.select(F.col("b").alias("c"), F.col("a").alias("v")))
    degree = arcs.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").withColumn("deg", F.col("n"))
    ends = join_skewed(arcs, written(degree, "degrees"), ["c"], "deg").withColumn("hub", F.col("c"))
    return written(paired(ends, "hub", "n", "v").where("v_a < v_b").select(F.col("c_a").alias("c"), F.col("v_a").alias("x"), F.col("v_b").alias("y")), "wedges")


def closing(between: DataFrame, near: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: the ends of ``between`` (wedges of ``near``) that share a key and aren't edges of ``near``."""
    keys = nodes.select("node", "keys")
    ends = between.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct().join(near.select("a", "b"), ["a", "b"], "left_anti")
    ends = ends.join(keys.select(F.col("node").alias("a"), F.col("keys").alias("ka")), "a").join(keys.select(F.col("node").alias("b"), F.col("keys").alias("kb")), "b")
    return ends.where(F.arrays_overlap("ka", "kb")).select("a", "b")


def scored(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, score (log odds of being one work), strong (evidence beyond the title) of the edges a, b, whole; of those that aren't whole, the ones within reach.

    Abstracts, the widest attribute, are compared only for pairs that they may still
    decide: the others stay under the floor of the propagation whatever they say.
    """
    f = nodes.select("node", "arxiv", "doi", "title", "words", "cut", "people", "families", "year")
    a = f.select(*[F.col(c).alias("a_" + c) for c in f.columns])
    b = f.select(*[F.col(c).alias("b_" + c) for c in f.columns])
    p = edges.join(a, F.col("a") == F.col("a_node")).join(b, F.col("b") == F.col("b_node"))
    a_longer, b_longer = F.col("a_title").startswith(F.col("b_title")), F.col("b_title").startswith(F.col("a_title"))
    both = F.size(F.array_intersect("a_words", "b_words"))
    # Each measure is made once per pair, before the cases that use it several times.
    p = p.withColumns({
        "words_both": both, "fuzz": 1 - F.levenshtein("a_title", "b_title") / F.greatest(F.length("a_title"), F.length("b_title"), F.lit(1)), "begins": a_longer | b_longer,
        "fam": _share(F.col("a_families"), F.col("b_families")), "ppl": _share(F.col("a_people"), F.col("b_people")),
    })
    title = F.when((F.size("a_words") > 0) & (F.size("b_words") > 0), F.col("words_both") / F.least(F.size("a_words"), F.size("b_words")))
    more = F.greatest(F.size("a_words"), F.size("b_words")) - F.col("words_both")
    fuzzy = F.col("fuzz")
    rest = F.when(a_longer, F.expr("substr(a_title, length(b_title) + 1)")).when(b_longer, F.expr("substr(b_title, length(a_title) + 1)"))
    told_apart = F.regexp_extract("a_title", SEQUEL, 0) != F.regexp_extract("b_title", SEQUEL, 0)
    revisited = F.when(F.col("begins"), rest.rlike(f"^ ?{SEQUEL}")).when(F.col("a_cut") | F.col("b_cut"), False).otherwise(told_apart)
    cut = F.col("a_cut") | F.col("b_cut") | F.col("begins")
    t = (
        F.when(title.isNull(), 0.0)
        .when(revisited, -6.0)
        .when((more == 0) & (F.col("a_title") == F.col("b_title")), 3.0)
        .when(fuzzy >= 0.9, 2.5)
        .when(cut & (title >= 0.85), 1.5)
        .when((title >= 0.8) | (fuzzy >= 0.8), 1.0)
        .when(title >= 0.6, -2.0)
        .otherwise(-7.0)
    )
    fam, ppl = F.col("fam"), F.col("ppl")
    close = F.greatest(F.coalesce(fam, F.lit(0.0)), F.when(ppl >= 0.75, ppl).otherwise(0.0))
    w = F.when(fam.isNull() & ppl.isNull(), 0.0).when(close >= 0.8, 2.5).when(close >= 0.5, 1.0).when(close >= 0.3, -1.5).otherwise(-4.0)
    ax = F.when(F.col("a_arxiv").isNull() | F.col("b_arxiv").isNull(), 0.0).when(F.col("a_arxiv") == F.col("b_arxiv"), 6.0).otherwise(-6.0)
    doi = F.when(F.col("a_doi").isNull() | F.col("b_doi").isNull(), 0.0).when(F.col("a_doi") == F.col("b_doi"), 4.0).otherwise(-3.0)
    gap = F.abs(F.col("a_year") - F.col("b_year"))
    y = F.when(gap.isNull(), 0.0).when(gap == 0, 1.0).when(gap == 1, 0.3).when(gap == 2, -1.0).otherwise(-3.0)
    first = written(p.select("a", "b", "whole", (t + w + ax + doi + y - 1.0).alias("score"), ((ax > 0) | (doi > 0) | (w >= 1.0)).alias("strong")), "titles")
    texts = nodes.select("node", "abstract")
    first = first.where(F.col("whole") | (F.col("score") + MOST_BY_ABSTRACT >= REACH))
    open_ = first.where(F.col("score") + MOST_BY_ABSTRACT > FLOOR)
    q = open_.join(texts.withColumnsRenamed({"node": "a", "abstract": "a_abstract"}), "a").join(texts.withColumnsRenamed({"node": "b", "abstract": "b_abstract"}), "b")
    q = q.withColumn("ab", _share(F.col("a_abstract"), F.col("b_abstract")))
    ab = F.col("ab")
    enough = F.least(F.size("a_abstract"), F.size("b_abstract")) >= 8
    s = F.when(ab.isNull() | ~enough, 0.0).when(ab >= 0.75, MOST_BY_ABSTRACT).when(ab >= 0.5, 3.5).when(ab >= 0.35, 0.0).otherwise(-5.0)
    decided = q.select("a", "b", "whole", (F.col("score") + s).alias("score"), (F.col("strong") | (s > 0)).alias("strong")).where(F.col("whole") | (F.col("score") >= REACH)).drop("whole")
    return decided.unionByName(first.where(F.col("score") + MOST_BY_ABSTRACT <= FLOOR).drop("whole"))


def refined(near: DataFrame, against: DataFrame, between: DataFrame) -> DataFrame:
    """Scores after propagation: an edge gains where both ends agree about a common neighbour, and loses where they don't.

    A triangle has two sides within reach (``near``) at least, which are a wedge of
    ``between``; its third side may be out of reach (``against``).
    """
    clip = lambda c: F.greatest(F.lit(FLOOR), F.least(F.lit(-FLOOR), c))
    base = written(near.withColumn("near", F.lit(True)).unionByName(against.withColumn("near", F.lit(False))), "scores")
    side = lambda u, v: F.struct(F.least(u, v).alias("a"), F.greatest(u, v).alias("b"))
    turn = lambda u, v, w: F.struct(side(u, v).alias("e"), side(u, w).alias("p"), side(v, w).alias("q"))
    # Three sides within reach are three wedges, each of which tells one side; else the one wedge tells all.
    closed = between.join(base.select(F.col("a").alias("x"), F.col("b").alias("y"), "near"), ["x", "y"])
    one, all_ = F.array(turn("x", "y", "c")), F.array(turn("x", "y", "c"), turn("x", "c", "y"), turn("y", "c", "x"))
    triangles = closed.select(F.explode(F.when(F.col("near"), one).otherwise(all_)).alias("t")).select("t.e.a", "t.e.b", F.col("t.p.a").alias("p1"), F.col("t.p.b").alias("p2"), F.col("t.q.a").alias("q1"), F.col("t.q.b").alias("q2"))
    triangles = written(triangles, "triangles")
    now = base
    while True:
        s = now.select("a", "b", "score")
        t = triangles.join(s.withColumnsRenamed({"a": "p1", "b": "p2", "score": "sp"}), ["p1", "p2"]).join(s.withColumnsRenamed({"a": "q1", "b": "q2", "score": "sq"}), ["q1", "q2"])
        sp, sq = clip(F.col("sp")), clip(F.col("sq"))
        push = F.when((sp > 0) & (sq > 0), F.least(sp, sq)).when((sp > 0) != (sq > 0), -F.least(F.abs(sp), F.abs(sq))).otherwise(0.0)
        moved = t.groupBy("a", "b").agg((F.avg(push) * F.least(F.lit(1.0), F.count("*") / 2)).alias("push"))
        after = base.withColumnRenamed("score", "own").join(moved, ["a", "b"], "left").join(s, ["a", "b"]).select("a", "b", "strong", (F.col("own") + 0.5 * F.coalesce("push", F.lit(0.0))).alias("new"), "score")
        after = written(after, "scores")
        change = after.agg(F.max(F.abs(F.col("new") - F.col("score")))).first()[0]
        now = after.select("a", "b", F.col("new").alias("score"), "strong")
        if change is None or change < STABLE:
            return now


def neighbours(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The edges within reach, those out of reach that speak against them, and the wedges of the first, for ``refined``."""
    near = written(scored(candidates(nodes).withColumn("whole", F.lit(False)), nodes), "near")
    between = wedges(near)
    return near, scored(closing(between, near, nodes).withColumn("whole", F.lit(True)), nodes), between


def matches(nodes: DataFrame) -> DataFrame:
    """a, b, score of the accepted edges between nodes."""
    edges = written(refined(*neighbours(nodes)), "refined")
    good = edges.where(F.col("score") >= ACCEPT)
    strong = good.where("strong")
    held = strong.select(F.col("a").alias("x")).unionByName(strong.select(F.col("b").alias("x"))).distinct()
    weak = good.where("not strong")
    arcs = weak.select(F.col("a").alias("x"), F.struct("score", F.col("b").alias("y")).alias("e")).unionByName(weak.select(F.col("b").alias("x"), F.struct("score", F.col("a").alias("y")).alias("e")))
    best = arcs.join(held, "x", "left_anti").groupBy("x").agg(F.max("e").alias("e")).select(F.least("x", "e.y").alias("a"), F.greatest("x", "e.y").alias("b"), "e.score")
    return strong.select("a", "b", "score").unionByName(best).groupBy("a", "b").agg(F.max("score").alias("score"))


def works(features: DataFrame) -> DataFrame:
    """rec_id, source, part (one value for each work), n (records of the work), sure; for every record, those that match nothing are works of their own."""
    nodes = written(features.groupBy("node").agg(*[F.first(c).alias(c) for c in ("arxiv", "doi", "title", "words", "cut", "abstract", "people", "families", "year", "keys")]).where(F.size("keys") > 0), "nodes")
    own = features.select("rec_id", "source", F.when(F.size("keys") > 0, F.col("node")).otherwise(F.xxhash64("rec_id", F.lit("alone"))).alias("node"))
    links = written(matches(nodes), "links")
    sure = links.select(F.col("a").alias("node"), "score").unionByName(links.select(F.col("b").alias("node"), "score")).groupBy("node").agg((1 / (1 + F.exp(-F.max("score")))).alias("sure"))
    # A node may stand for very many equal records, so its size goes with it.
    sizes = own.groupBy("node").agg(F.count("*").alias("c"))
    parts = sizes.join(components(links).join(sure, "node"), "node", "left").select("node", "c", F.coalesce("root", "node").alias("part"), F.coalesce("sure", F.lit(1.0)).alias("sure"))
    parts = written(parts, "parts")
    members = parts.groupBy("part").agg(F.sum("c").alias("n"))
    parts = parts.join(members, "part")
    return written(join_skewed(own, written(parts, "parts"), ["node"], "c").select("rec_id", "source", "part", "n", "sure"), "named")


def unified(s2: DataFrame | None, oa: DataFrame | None, ax: DataFrame | None) -> DataFrame:
    """The three feeds in one schema."""
    out = []
    none = F.lit(None).cast("string")
    if s2 is not None:
        out.append(s2.select("rec_id", F.lit("s2_papers").alias("source"), "title", F.col("abstract_text").alias("abstract"), "authors", "year", F.col("publication_date").alias("date"), F.col("external_ids.doi").alias("doi"), F.col("external_ids.arxiv_id").alias("arxiv")))
    if oa is not None:
        out.append(oa.select("rec_id", F.lit("oa_works").alias("source"), "title", F.col("abstract_text").alias("abstract"), "authors", F.lit(None).cast("int").alias("year"), F.col("publication_date").alias("date"), "doi", F.col("arxiv_id").alias("arxiv")))
    if ax is not None:
        out.append(ax.select("rec_id", F.lit("arxiv_papers").alias("source"), "title", F.col("summary").alias("abstract"), "authors", F.lit(None).cast("int").alias("year"), F.col("published").alias("date"), none.alias("doi"), F.col("arxiv_id").alias("arxiv")))
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows


def cross_matches(named: DataFrame) -> DataFrame:
    """rec_a, rec_b, confidence of different sources in one work."""
    pairs = paired(named.where("n > 1").select("rec_id", "source", "sure", "part", "n"), "part", "n", "rec_id").where("source_a <> source_b and rec_id_a < rec_id_b")
    return pairs.select(F.col("rec_id_a").alias("rec_a"), F.col("rec_id_b").alias("rec_b"), F.round(F.least("sure_a", "sure_b"), 4).alias("confidence"))
