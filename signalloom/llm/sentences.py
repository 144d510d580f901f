"""Sentence boundaries across languages and scripts.

Document-centred disambiguation: whether a token with a period is an
abbreviation is decided from its unambiguous occurrences in the same text
(without a period, or with a period before a lower-case word or number); where
these are silent or divided, from counts over the whole corpus; where these are
silent too, from a short list of known abbreviations.  Whether a capital after an
abbreviation begins a sentence or a name is decided in the same way: from
occurrences of the word in lower case, or capitalised inside a sentence, in
the text, then in the corpus.  Initials and tokens with inner periods are told by
their form.  Other scripts have their own terminators; in Thai a space ends a
sentence unless it sets off a number or a Latin word.

Bounds that are part of the rules: a token of more than ``LONGEST`` characters is no
abbreviation, and of more than ``COUNTED`` none by the corpus; a word of more than ``SHORT`` letters is one only if the corpus or the
list says so; an opening bracket or quote closes within the ``DEPTH`` innermost
open ones; one left open in the last ``TAIL`` characters of a text runs to its end.

Two passes over the texts: token counts (added up per partition before the
shuffle), then the splitting, which needs no shuffle.  Only the types that pass
the thresholds form the lexicon; it is broadcast while it has at most
``MAX_BROADCAST`` rows, beyond that each text gets its own part by a join.

Defined results: null and blank texts give no rows; a repeated row gives its
sentences again; offsets count code points from 0, end exclusive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.storage import written

MAX_BROADCAST = 200_000
MIN_COUNT = 5
LONGEST, COUNTED, SHORT, DEPTH, TAIL = 40, 12, 6, 3, 400

# Abbreviations that expect a name or a number after them.
BEFORE_NAMES = "Mr Mrs Ms Dr Prof St Gen Col Capt Lt Sgt Rev Hon Gov Sen Rep Messrs Mme Mlle MM Mgr Sr Sra Srta Dra Dres Ing Lic Hr Fr Frl Dipl д-р проф акад г-н г-жа им ул डॉ श्री د أ ดร นพ"
BEFORE_NUMBERS = "No Nos Nr Fig Figs Sec Sect Ch Chap Vol p pp par art eq Eq Eqs Tab Abb Bd Kap S ca approx cf núm pág págs cap fig figs n° рис табл стр гл см См सं"
# Abbreviations inside sentences that may also end one.
INSIDE = "e.g i.e vs al etc viz Inc Ltd Co Corp Jr Bros est dept bzw usw evtl ggf inkl vgl Std Min Mio Mrd z.B d.h u.a janv févr avr juil sept oct nov déc p.ex EE UU т.е т.д т.п др г гг тыс млн руб Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec"
# German words before ordinal numbers.
BEFORE_ORDINALS = frozenset("am der dem den des die das zum zur vom beim ab bis im seit".split())

_TERM = r".!?…。！？।॥؟۔｡"
_OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "‹": "›", "‘": "’"}
_OPEN.pop("‘")
_CLOSE = frozenset(")]}”»」』）】》›")
_STRONG = frozenset("。！？।॥؟۔｡")
_ROUND = frozenset("([{（【")
_TOKENS = re.compile(r'(?P<t>[.!?…。！？।॥؟۔｡]+)|(?P<b>[(\[{“„«「『（【《‹)\]}”»」』）】》›"])|(?P<z>(?<=[฀-๿?!])\s+(?=[฀-๿A-Z]))')
_WORD_BEFORE = re.compile(r"(?:[^\W_]|[̀-ͯऀ-ःऺ-ॏั-๎]|[.\-'’/])+$")
_NEXT = re.compile(r"(?:[^\W_]|[\-'’])+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯＀-￯]")
_THAI = re.compile(r"[฀-๿]")
_BREAK = re.compile(r"\n[^\S\n]*(?:\n\s*)+|\n(?=[^\S\n]*(?:[-*•–‣◦]|#{1,6})\s)|\r\n\s*\r\n\s*|[ \f]")
_ITEM = re.compile(r"\s*(?:[-*•–‣◦]|#{1,6})\s")
_NUMBERED = re.compile(r"\n(?=[^\S\n]*\d{1,3}[.)]\s)")
_PARAGRAPH = re.compile(r"\n\s*\n")
_LEAD = re.compile(r"^.*[\s(«“\"„¿¡\[{/]|^['’\-]+")


def _known() -> dict[str, str]:
    return {w: "T" for w in BEFORE_NAMES.split()} | {w: "A" for w in (BEFORE_NUMBERS + " " + INSIDE).split()}


KNOWN = _known()
NUMBERED = frozenset(BEFORE_NUMBERS.split())
# Words of the list that are ordinary words as well; for them the list alone says nothing.
ORDINARY_TOO = frozenset("no No al Co Min art Fr par S".split())


def token_before(text: str, at: int, start: int) -> str:
    """The token that ends right before a period, cut at the last change from a script without spaces."""
    start = max(start, at - LONGEST)
    w = text[max(start, text.rfind(" ", start, at) + 1) : at]
    if w.isascii() and w.isalnum():
        return w
    m = _WORD_BEFORE.search(w)
    if not m:
        return ""
    w = m[0].lstrip(".-'’/")
    if _CJK.search(w) and not _CJK.match(w[-1]):
        w = re.split(_CJK, w)[-1].lstrip(".-'’/")
    return w


class Counts:
    """Counts of (token, kind) over texts.

    Tokens are counted as they stand, and only the distinct ones are looked into; the
    places where a period, or the begin of a sentence, matters are looked at one by one.
    Kinds: how tokens with a period go on (low, dig, name, up, oth), tokens without one (bare),
    words in lower case after a terminator (lowstart) or inside a sentence (middle);
    and, under their lower-case form, capitalised words inside a sentence (inner) and
    after a short token with a period (start).
    """

    def __init__(self):
        self.raw: Counter = Counter()
        self.seen: Counter = Counter()

    def add(self, text: str) -> None:
        tokens = (_PARAGRAPH.sub(" \0 ", text) if "\n" in text else text).split()
        self.raw.update(tokens)
        seen, end, before = self.seen, "\0", "\0"
        for i, t in enumerate(tokens):
            inside = end == "," or end.islower()
            if t[0].islower():
                if not inside:
                    w = t.rstrip(_AFTER)
                    seen[w, "away"] += 1
                    if end in "?!\0" or before[-2:] in _ENDED or end == "." and len(before) > 7 and before[-8:-1].isalpha():
                        seen[w, "lowstart"] += 1
            elif inside and t[0].isupper():
                seen[t.rstrip(_AFTER).lower(), "inner"] += 1
            before, end = t, t[-1]
            if end == ".":
                self._period(tokens, i)

    def _period(self, tokens: list[str], i: int) -> None:
        w = _LEAD.sub("", tokens[i][:-1])
        if w and len(w) <= COUNTED and i + 1 < len(tokens) and any(map(str.isalpha, w)):
            if _CJK.search(w):
                w = re.split(_CJK, w)[-1]
            if w and (kind := _follows(tokens[i + 1], tokens[i + 2][0] if i + 2 < len(tokens) else "")):
                self.seen[w, kind] += 1
                if kind in ("name", "up") and len(w) <= SHORT:
                    self.seen[tokens[i + 1].rstrip(_AFTER).lower(), "start"] += 1

    def items(self) -> Counter:
        out = Counter({k: n for k, n in self.seen.items() if k[1] != "away"})
        for t, n in self.raw.items():
            if t[-1] != ".":
                w = t.strip(_AROUND)
                if len(w) <= SHORT and w.isalpha():
                    out[w, "bare"] += n
            if t[0].islower():
                out[t.rstrip(_AFTER), "middle"] += n
        for (w, kind), n in self.seen.items():
            if kind == "away":
                out[w, "middle"] -= n
        return out


_AFTER, _AROUND, _ENDED = ",;:.!?)”\"»", "(«“\"„¿¡[{,;:!?)»”]}", ('?"', '!"', "?”", "!”")


def _follows(x: str, y: str) -> str:
    """How a text goes on after a period, from the next token and the first character of the one after it."""
    if x[0].islower() or x[0] in ",;:":
        return "low"
    if x[0].isupper():
        return "name" if len(x) == 1 or x[1] == "." or y.isupper() else "up"
    return "dig" if x[0].isdigit() else "oth" if x[0].isalpha() else ""


def corpus_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """token, kind, n over all texts; counts are added up in each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counts()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    c.add(t)
            if len(c.raw) > 300_000:
                yield out(c.items())
                c = Counts()
        yield out(c.items())

    def out(c: Counter) -> pa.RecordBatch:
        keys = list(c)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([c[k] for k in keys], pa.int64())], ["token", "kind", "n"])

    return docs.select(F.col(text)).mapInArrow(run, "token string, kind string, n long").groupBy("token", "kind").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text: str = "text") -> DataFrame:
    """token, kind: A goes on after its period, T expects a name, L starts sentences in lower case, S is hardly capitalised but where a sentence starts."""
    kinds = ["low", "dig", "name", "up", "oth", "bare", "lowstart", "middle", "inner", "start"]
    c = corpus_counts(docs, text).groupBy("token").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in kinds])
    on, ends = F.col("low") + F.col("dig"), F.col("up") + F.col("oth")
    total = on + ends + F.col("name")
    kind = (
        F.when((total >= MIN_COUNT) & (F.col("bare") <= 0.02 * total) & (F.col("name") >= 0.6 * total), "T")
        .when((total >= MIN_COUNT) & (on >= 0.6 * total), "A")
        .when((F.col("lowstart") >= MIN_COUNT) & (F.col("middle") <= 0.05 * F.col("lowstart")), "L")
        .when((F.col("start") >= MIN_COUNT) & (F.col("middle") >= MIN_COUNT) & (F.col("inner") <= 0.05 * F.col("middle")), "S")
    )
    return c.select("token", kind.alias("kind")).where(F.col("kind").isNotNull())


class _Text:
    """Evidence of one text, looked up when it is first asked for."""

    def __init__(self, text: str, lex: dict[str, str]):
        self.text, self.lex, self._seen, self._names = text, lex, {}, {}

    def seen(self, w: str) -> tuple[int, int]:
        """(occurrences that go on after the period, occurrences without a period)."""
        if w not in self._seen:
            text, at, on, bare, n = self.text, self.text.find(w), 0, 0, len(w)
            while at >= 0:
                end = at + n
                after = text[end : end + 1]
                if not (at and (text[at - 1].isalnum() or text[at - 1] in ".-'’")) and not after.isalnum():
                    if after == ".":
                        rest = text[end + 1 : end + 40]
                        x = rest.lstrip()
                        nxt = _NEXT.match(x)
                        on += rest[:1].isspace() and "\n\n" not in rest[:3] and (x[:1].islower() or x[:1].isdigit()) and not (nxt and self.lex.get(nxt[0]) == "L")
                    elif after not in ("-", "'", "’"):
                        bare += 1
                at = text.find(w, end)
            self._seen[w] = on, bare
        return self._seen[w]

    def begins(self, word: str) -> bool:
        """Whether a capital says that a sentence begins: the word stands in lower case elsewhere in the text and not capitalised inside a sentence; where the text is silent, the corpus decides."""
        if word not in self._names:
            low = word.lower()
            lower, inner = self._whole(low), self._capitalised(word)
            self._names[word] = lower > inner if lower or inner else self.lex.get(low) == "S"
        return self._names[word]

    def _whole(self, w: str) -> int:
        """Occurrences as a whole word."""
        text, n, k, at = self.text, 0, len(w), self.text.find(w)
        while at >= 0:
            n += not (at and text[at - 1].isalnum()) and not text[at + k : at + k + 1].isalnum()
            at = text.find(w, at + k)
        return n

    def _capitalised(self, word: str) -> int:
        """Occurrences right after a lower-case letter or a comma and a blank, that is inside a sentence."""
        text, n, k, at = self.text, 0, len(word), self.text.find(word)
        while at >= 0:
            n += at > 1 and text[at - 1] == " " and (text[at - 2] == "," or text[at - 2].islower()) and not text[at + k : at + k + 1].isalnum()
            at = text.find(word, at + k)
        return n

    def kind(self, w: str) -> str:
        """I initial, T, A as in the lexicon, E short with inner periods, W a word of the text although corpus or list have it as an abbreviation, or '' for an ordinary word."""
        if len(w) == 1 or len(w) == 2 and w[1] in "́̈":
            return "I" if w.isalpha() else ""
        if "." in w:
            if re.fullmatch(r"(?:[^\W\d_]\.)*[^\W\d_](?:-[^\W\d_])?", w):
                return "A" if w.islower() else "I" if self.lex.get(w) == "T" else "E"
            tail = w.rsplit(".", 1)[1]
            if len(tail) == 1 and tail.isupper() or KNOWN.get(tail) == "T":
                return "I"
        corpus = self.lex.get(w, "")
        corpus = corpus if corpus in "AT" else ""
        known = KNOWN.get(w, "") if corpus or w not in ORDINARY_TOO else ""
        if corpus or known or len(w) <= SHORT:
            on, bare = self.seen(w)
            if bare > on:
                return "W" if corpus or known else ""
            if on and not bare and not corpus and not known and len(w) <= 4:
                return "A"
        return corpus or known


def looked_up(text: str) -> set[str]:
    """Every token that splitting the text may look up in the lexicon: words before a period, and all words that may follow a terminator."""
    words = _NEXT.findall(text)
    out = set(words) | {w.lower() for w in words if w[0].isupper()} | {c for c in set(text) if c.islower()}
    at = text.find(".")
    while at >= 0:
        out.add(token_before(text, at, 0))
        # As seen() does, which looks no further than this for the next word.
        if m := _NEXT.match(text[at + 1 : at + 40].lstrip()):
            out.add(m[0])
        at = text.find(".", at + 1)
    return out


def _period(doc: _Text, i: int, j: int, s: int, e: int) -> bool:
    """Whether the single period at i, with white space from j, ends a sentence."""
    text = doc.text
    k = j
    while k < e and text[k].isspace():
        k += 1
    if k >= e:
        return True
    w = token_before(text, i, s)
    x = text[k]
    nxt = _NEXT.match(text, k)
    word = nxt[0] if nxt else x
    if not w:
        return not x.islower() or doc.lex.get(word) == "L"
    if w.isdigit():
        before = token_before(text, i - len(w) - 1, s) if i - len(w) - 1 > s else ""
        if len(w) <= 2 and before.lower() in BEFORE_ORDINALS and (x.isupper() or x.islower()):
            return False
        if i - len(w) <= s and len(w) <= 3:
            return False
        return not x.islower() or doc.lex.get(word) == "L"
    kind = doc.kind(w)
    if x.islower():
        if doc.lex.get(word) == "L" and kind in ("", "E", "W"):
            return True
        if kind:
            return False
        return doc.lex.get(word) == "L" or len(w) > 5 or doc.seen(w)[1] > 0
    if x.isdigit():
        return kind in ("", "E")
    if x.isupper():
        if kind in ("I", "T"):
            return False
        if kind == "E":
            return True
        if kind in ("A", "W"):
            own = nxt and nxt.end() < e and text[nxt.end()] == "." and (word in KNOWN or len(word) <= 2)
            if own or not nxt:
                return not own
            return kind == "W" or KNOWN.get(w) != "T" and w not in NUMBERED and doc.begins(word)
        return True
    if x.isalpha():
        return kind in ("", "E")
    return kind in ("", "E") or x in "-*•" and kind == "E"


def _matches(tokens: list, text: str, e: int, last: bool) -> dict[int, int]:
    """Closing position of each opening one; open ends of a cut-off text close at its end."""
    stack: list[tuple[str, int]] = []
    out: dict[int, int] = {}
    for m in tokens:
        if m.lastgroup != "b":
            continue
        ch, at = m[0], m.start()
        if ch == '"':
            if stack and any(o == '"' for o, _ in stack):
                ch_open = False
            else:
                ch_open = True
        elif ch == "“":
            ch_open = not (stack and stack[-1][0] == "„")
        else:
            ch_open = ch in _OPEN
        if ch_open:
            stack.append((ch, at))
            continue
        for k in range(len(stack) - 1, max(-1, len(stack) - 1 - DEPTH), -1):
            o = stack[k][0]
            if o == '"' == ch or _OPEN.get(o) == ch:
                out[stack[k][1]] = at
                del stack[k:]
                break
    if last:
        for _, at in stack:
            if e - at < TAIL and at not in out:
                out[at] = e
                break
    return out


def _block(doc: _Text, s: int, e: int, last: bool, cuts: list[int]) -> None:
    """Add the ends of sentences inside one paragraph, heading or list item."""
    text = doc.text
    tokens = list(_TOKENS.finditer(text, s, e))
    if not tokens:
        return
    closing = _matches(tokens, text, e, last) if any(m.lastgroup == "b" for m in tokens) else {}
    begin, inside, opened, alone = s, -1, "", False
    stop = s + len(text[s:e].rstrip())
    for m in tokens:
        i, j, group = m.start(), m.end(), m.lastgroup
        if inside >= 0 and i < inside:
            continue
        end = 0
        if inside >= 0 and i == inside:
            inside = -1
            k = j
            inner = text[opened_at + 1 : i].rstrip()
            if inner and inner[-1] in _TERM:
                end = _after_quote(doc, inner[-1], opened, alone, opened_at, k, s, e) and k
        elif group == "b":
            if i in closing:
                inside, opened, opened_at = closing[i], m[0], i
                alone = not text[begin:i].strip()
                if inside == e:
                    break
            continue
        elif group == "t":
            end = _terminator(doc, m[0], i, j, s, stop) and j
        elif group == "z":
            end = _thai_space(text, i, j, s, e) and i
        if end:
            cuts.append(end)
            begin = end


def _after_quote(doc: _Text, inner: str, opened: str, alone: bool, opened_at: int, k: int, s: int, e: int) -> bool:
    text = doc.text
    n = k
    while n < e and text[n].isspace():
        n += 1
    if n >= e:
        return True
    x = text[n]
    if x in _TERM or x in ",;:，、；：،)]”»":
        return False
    if inner in _STRONG and n == k or _CJK.match(x) and n == k:
        if opened in _ROUND:
            return alone
        before = text[s:opened_at].rstrip()[-1:]
        return not alone and before in ":：" and before != "" and not text.startswith(("と", "って"), n)
    if n == k:
        return False
    if opened in _ROUND and not alone:
        return False
    nxt = _NEXT.match(text, n)
    if x.islower():
        return doc.lex.get(nxt[0]) == "L" if nxt else False
    if inner == "." and doc.kind(token_before(text, text.rfind(".", opened_at, k), opened_at + 1)) in ("I", "T", "A") and opened in _ROUND and not alone:
        return False
    return x not in "-–—"


def _terminator(doc: _Text, mark: str, i: int, j: int, s: int, e: int) -> bool:
    text = doc.text
    if j >= e:
        return False
    x = text[j]
    if mark == ".":
        return x.isspace() and _period(doc, i, j, s, e)
    if any(c in _STRONG for c in mark):
        return x not in "」』”»）)\"" and not (x in "，、")
    if mark[0] in "…" or len(mark) > 1 and set(mark) <= set(".…"):
        if not x.isspace():
            return False
        rest = text[j : min(e, j + 60)].lstrip() or " "
        nxt = _NEXT.match(rest)
        return not rest[0].islower() and rest[0] not in ",;:—–-" or bool(nxt) and doc.lex.get(nxt[0]) == "L"
    if "!" in mark or "?" in mark:
        if x.isspace():
            rest = text[j : min(e, j + 60)].lstrip()
            if not rest:
                return True
            nxt = _NEXT.match(rest)
            if rest[0].islower():
                return bool(nxt) and doc.lex.get(nxt[0]) == "L"
            return rest[0] not in ",;:"
        return bool(_CJK.match(x) or _THAI.match(x))
    return x.isspace() and _period(doc, i, j, s, e)


def _thai_space(text: str, i: int, j: int, s: int, e: int) -> bool:
    a, b = text[i - 1] if i > s else "", text[j] if j < e else ""
    if a in "?!" or not _THAI.match(a or " "):
        return False
    if _THAI.match(b or " "):
        return b not in "ๆฯ"
    # A Latin sentence of its own, not a single word that is set off.
    run = re.match(r"[^฀-๿]+", text[j:e])
    return bool(run) and len(run[0].split()) >= 4 and bool(re.search(r"[.!?](?:\s|$)", run[0]))


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Paragraphs, headings and list items as (start, end)."""
    at = 0
    for m in _BREAK.finditer(text):
        yield from _numbered(text, at, m.start())
        at = m.end()
    yield from _numbered(text, at, len(text))


def _numbered(text: str, s: int, e: int) -> Iterator[tuple[int, int]]:
    """Split a block whose first line is item 1 of a numbered list."""
    if (m := re.match(r"\s*1[.)]\s", text[s : s + 12])) and (cuts := list(_NUMBERED.finditer(text, s, e))):
        at, want = s, 2
        for c in cuts:
            if re.match(rf"\s*{want}[.)]\s", text[c.start() : c.start() + 12]):
                yield at, c.start()
                at, want = c.end(), want + 1
        yield at, e
    elif s < e:
        yield s, e


def split_text(text: str | None, lex: dict[str, str]) -> list[tuple[int, int]]:
    """Sentences of one text as code-point offsets; together they cover all but white space."""
    if not text or not text.strip():
        return []
    doc = _Text(text, lex)
    out = []
    total = len(text.rstrip())
    for s, e in _blocks(text):
        cuts: list[int] = []
        m = _ITEM.match(text, s, e)
        _block(doc, m.end() if m else s, e, e >= total, cuts)
        at = s
        for cut in [*cuts, e]:
            piece = text[at:cut]
            if piece.strip():
                out.append((at + len(piece) - len(piece.lstrip()), at + len(piece.rstrip())))
            at = cut
    return out


def _offsets(batch: pa.RecordBatch, lexicons) -> pa.RecordBatch:
    rows, starts, ends = [], [], []
    for r, (text, lex) in enumerate(zip(batch.column(1).to_pylist(), lexicons)):
        for a, b in split_text(text, lex):
            rows.append(r)
            starts.append(a)
            ends.append(b)
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "sent_start", "sent_end"])


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, sent_start, sent_end of every sentence of every text."""
    spark = docs.sparkSession
    lex = written(lexicon(docs, text), "lexicon")
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, sent_start long, sent_end long"
    if lex.count() <= max_broadcast:
        shared = spark.sparkContext.broadcast({r.token: r.kind for r in lex.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    yield _offsets(part, [shared.value] * part.num_rows)

        return source.mapInArrow(run, schema)

    # Beyond the bound: the tokens of each text are joined with the lexicon, and each text gets its own part.
    numbered = source.withColumn("row", F.monotonically_increasing_id())
    numbered = written(numbered, "numbered")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = sorted(looked_up(t or ""))
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int64()), pa.array(found, pa.string())], ["row", "token"])

    own = numbered.select("row", "text").mapInArrow(tokens, "row long, token string").join(lex, "token").groupBy("row").agg(F.collect_list(F.struct("token", "kind")).alias("lex"))

    def run_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _offsets(batch, [{x["token"]: x["kind"] for x in part or []} for part in batch.column(2).to_pylist()])

    return numbered.join(own, "row", "left").select("doc_id", "text", "lex").mapInArrow(run_own, schema)
