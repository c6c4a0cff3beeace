"""Operator 9, personal data: base patterns plus a linear-chain conditional random field over word shapes.

The base kinds (email, ip, card, phone) are found by pattern. The model adds what the patterns miss, such as
numbers and addresses in other notations: a linear-chain CRF with the tags of TAGS over word-shape features,
trained by maximum likelihood (forward-backward gradients) on LABELLED, a small table of tagged phrases, and
decoded by Viterbi in numpy batches. Every text is decoded as one sequence of all its words: the texts of a
batch go forward side by side, longest first, and each keeps its state to its own end, so that nothing is cut.

Positions are code points, end exclusive. A model span that touches a base span is left out. Defined cases: a
null text counts as empty; a text without hits has zeros, the hash of the empty string and no spans; rows
with equal or null doc_ids get a row each; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits

TAGS = ("O", "email", "ip", "card", "phone", "id")
RIDGE, STEPS, TOGETHER = 0.05, 250, 1_000_000
#: The training table: phrases with entities in brackets as [tag words]. The rest is tag O.
LABELLED = """
please write to [email anna.k@mail.example.org] today
contact [email bob-smith@example.com] or call
reach us : [email info at example dot com] thanks
write to [email bob.smith at example dot org] or call
her address is [email anna at mail dot example dot net] and
mail [email j.doe (at) example (dot) com] then wait
contact [email sales (at) mail (dot) example (dot) org] today
ask [email carl dot meyer at mail dot example dot org] please
then anna wrote [email marie.17@post3.example.net] and others came
wonder [email paul.83@mail4.example.com.] Another day
nothing [email lee99@example.org,] perhaps something
then others saw [ip 203.0.113.57] and another came
wonder [ip 198.51.100.201.] Another day
nothing [ip 83.29.125.7,] perhaps something
is is is is is is is is is is
at at at at at at at at at at
we met anna at noon and bob at the house
look at the dot com boom of that year
he came at once to dot the line
they were at home or at sea
the internationalisation of multidimensional considerations and relationships
unquestionably extraordinarily knowledgeable schoolteachers recommended straightforwardness
Überwachung der Geschwindigkeitsbegrenzung für Straßenbahnen und Größenverhältnisse
Constantinople Neighbourhood Mediterranean Understanding Southeastern
la información está también más allá où élève être après déjà
so*** und&&& die### les$$$ a%%% very!! much&&& here*** today$$$
interesting.*** considering,&&& der.$$$ nothing.### whatever.*** again.%%%
WARNING!! STOP!! HELP!! EVERYTHING!! AGAIN!! NOW!!
Again Again Again Again Again Again Again Again Again Again
Atten. At At At At At At At At At At
something. Another. The. Onther, Later; Nobody: (perhaps) "quoted" it's well-known
one,two and/or e.g. i.e. Mr. A. B. Smith's re-elected part-time
mail [email j.doe7@example.co.uk,] then wait
her address is [email m_weiss99@post.example.net.] and
the host [ip 10.0.0.12] is down
from [ip 192.168.1.254,] to the gate
server at [ip 172.16.31.9:8080] answered
logged in from [ip fe80::1ff:fe23:4567:890a] last night
paid with [card 4111 1111 1111 1111] in may
card number [card 5500-0000-0000-0004] was declined
the card [card 378282246310005] expires
charged to [card 6011000990139424.] on monday
call [phone +1 (212) 555-0187] before noon
phone : [phone (030) 555 0199] ask for tom
ring [phone 020-7946-0958] or write
my number is [phone 555-0142,] after six
fax [phone +44 20 7946 0321] only
mobile [phone 0171/5550133] is off
ssn [id 078-05-1120] on file
passport [id C01X00T47] was issued
iban [id DE89 3704 0044 0532 0130 00] for payment
her number [id AB123456C] is known
tax id [id 12-3456789.] of the firm
in 1999 there were 24 boats and 3 ships
chapter 12 , page 345 of the book
the price fell by 15% to 300 in june
from 1914 to 1918 the war went on
about 1,000,000 people live there
version 2.4.1 was built on 2020-05-17
room 7 on floor 3 of house 21
at 10:30 we met 5 friends
the score was 3-2 after 90 minutes
see section 4.2 and table 17
he ran 100m in 9.58 seconds
order 66 came in the 3rd part
a total of 12 345 units
token = 4f2a9c then 77 more words
born in 1980 , died 2001
there are no numbers in this one
"""


_SHAPE = str.maketrans({c: x for cs, x in (("09", "d"), ("AZ", "X"), ("ÀÞ", "X"), ("az", "x"), ("ßÿ", "x")) for c in range(ord(cs[0]), ord(cs[1]) + 1)})


def shape(word: str) -> str:
    """Letters as x or X, digits as d, marks as they are; runs longer than four are cut to four."""
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1", word.translate(_SHAPE))


def features(word: str) -> tuple[str, ...]:
    """Word-shape features of one word."""
    digits = sum(c.isdigit() for c in word)
    short = re.sub(r"(.)\1+", r"\1", shape(word))
    out = ["s:" + shape(word), "t:" + short, f"n:{min(digits, 20)}", f"l:{min(len(word), 24) // 3}"]
    out += [f"m:{c}" for c in "@.:-+()/,%=" if c in word]
    if not digits and len(word) < 12:
        out.append("w:" + word.lower().strip(".,:;"))
    return tuple(out)


def labelled_rows() -> list[tuple[list[str], list[int]]]:
    """The training table as words and tag numbers."""
    rows = []
    for line in LABELLED.strip().splitlines():
        words, tags, tag = [], [], 0
        for part in line.split():
            if part[0] == "[":
                tag = TAGS.index(part[1:])
                continue
            closed = part.endswith("]")
            words.append(part[:-1] if closed else part)
            tags.append(tag)
            tag = 0 if closed else tag
        rows.append((words, tags))
    return rows


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@cache
def train() -> dict:
    """Feature numbers, emission weights (features of the word and of its neighbours), transitions."""
    rows = labelled_rows()
    names: dict[str, int] = {}
    for words, _ in rows:
        for w in words:
            for f in features(w):
                for side in ("0", "-", "+"):
                    names.setdefault(side + f, len(names))
    k = len(TAGS)
    encoded = []
    for words, tags in rows:
        own = [features(w) for w in words]
        x = np.zeros((len(words), len(names)))
        for i in range(len(words)):
            for side, j in (("0", i), ("-", i - 1), ("+", i + 1)):
                if 0 <= j < len(words):
                    x[i, [names[side + f] for f in own[j]]] = 1
        encoded.append((x, np.array(tags)))
    emit, step = np.zeros((len(names), k)), np.zeros((k, k))
    sum_e, sum_s = np.zeros_like(emit), np.zeros_like(step)
    for _ in range(STEPS):  # gradient ascent with per-weight step sizes
        grad_e, grad_s = -RIDGE * emit, -RIDGE * step
        for x, tags in encoded:
            score = x @ emit
            n = len(tags)
            forward, backward = np.zeros((n, k)), np.zeros((n, k))
            forward[0] = score[0]
            for i in range(1, n):
                forward[i] = score[i] + _log_sum(forward[i - 1][:, None] + step, 0)
            for i in range(n - 2, -1, -1):
                backward[i] = _log_sum(step + (score[i + 1] + backward[i + 1])[None, :], 1)
            total = _log_sum(forward[-1], 0)
            grad_e += x.T @ (np.eye(k)[tags] - np.exp(forward + backward - total))
            for i in range(1, n):
                grad_s[tags[i - 1], tags[i]] += 1
                grad_s -= np.exp(forward[i - 1][:, None] + step + (score[i] + backward[i])[None, :] - total)
        sum_e += grad_e**2
        sum_s += grad_s**2
        emit += 0.3 * grad_e / np.sqrt(sum_e + 1e-8)
        step += 0.3 * grad_s / np.sqrt(sum_s + 1e-8)
    return {"names": names, "emit": emit, "step": step}


def viterbi(scores: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best tags of a batch of sequences of one length: scores (batch, length, tags)."""
    batch, n, k = scores.shape
    return viterbi_rows(scores.reshape(-1, k), np.full(batch, n), step).reshape(batch, n)


def viterbi_rows(scores: np.ndarray, sizes: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best tags of sequences of any lengths over 0 that lie one after the other in scores (words, tags)."""
    k = step.shape[0]
    order = np.argsort(-sizes, kind="stable")
    starts, left = (np.cumsum(sizes) - sizes)[order], sizes[order]
    live = np.searchsorted(-left, -np.arange(left[0]), side="left")  # sequences longer than i: a leading part of the order
    back, tags, every = np.zeros((len(scores), k), np.int8), np.zeros(len(scores), np.int8), np.arange(len(sizes))
    best = scores[starts]
    for i in range(1, left[0]):
        m = live[i]
        if m < 64:  # few calls for few sequences, few bytes for many
            ways = best[:m, :, None] + step
            top, at = ways.max(axis=1), ways.argmax(axis=1)
        else:
            top, at = best[:m, :1] + step[0], np.zeros((m, k), np.int8)
            for j in range(1, k):
                way = best[:m, j : j + 1] + step[j]
                at[way > top] = j
                np.maximum(top, way, out=top)
        back[starts[:m] + i] = at
        best[:m] = top + scores[starts[:m] + i]
    last = best.argmax(axis=1)
    for i in range(left[0] - 1, -1, -1):
        m = live[i]
        tags[starts[:m] + i] = last[:m]
        if i:
            last[:m] = back[starts[:m] + i, last[:m]]
    return tags


_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind in the order email, ip, card, phone, then start."""
    out, at = [], 0
    sign = text.find("@")
    while sign >= 0:  # from each at sign to the left: linear in the text, where a left-to-right pattern is not
        start = sign
        while start > at and text[start - 1] in _LOCAL:
            start -= 1
        if start < sign and (m := _DOMAIN.match(text, sign + 1)):
            out.append(("email", start, m.end()))
            at = m.end()
        sign = text.find("@", max(at, sign + 1))
    if not re.search("[0-9]", text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p) < 4 and int(p) <= 255 or len(p) >= 4 and int(p[-30:]) <= 255 and not p[:-30].strip("0") for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


class Decoder:
    """The trained field, with the scores of known words remembered."""

    def __init__(self):
        self.model = train()
        self.plain = {name[3:] for name in self.model["names"] if name.startswith("0w:")}
        self.forget()

    def forget(self) -> None:
        self.known: dict = {}
        self.rows: list[np.ndarray] = []

    def place(self, word: str) -> int:
        """The row of what a word says about itself, the word after it and the word before it."""
        got = self.known.get(word)
        if got is None:
            # words that agree in every letter's shape differ by those alone that the training table has
            alike = word if word.lower().strip(".,:;") in self.plain else (word.translate(_SHAPE),)
            got = self.known.get(alike)
            if got is None:
                names, emit = self.model["names"], self.model["emit"]
                got = len(self.rows)
                self.rows.append(np.stack([emit[[names[side + f] for f in features(word) if side + f in names]].sum(axis=0) for side in "0-+"]))
                self.known[alike] = got
            self.known[word] = got
        return got

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Model spans of each text."""
        out: list[list] = [[] for _ in texts]
        held, places, sizes = [], [], []
        for r, text in enumerate(texts):
            words = _WORD.findall(text)
            if words:
                known = list(map(self.known.get, words))
                if None in known:
                    known = list(map(self.place, words))
                places.append(np.array(known, np.int64))
                held.append(r)
                sizes.append(len(words))
            if held and (sum(sizes) >= TOGETHER or r == len(texts) - 1):
                self.decode(texts, held, places, np.array(sizes), out)
                held, places, sizes = [], [], []
                if len(self.known) > 200_000:
                    self.forget()
        if held:
            self.decode(texts, held, places, np.array(sizes), out)
        return out

    def decode(self, texts, held, places, sizes, out) -> None:
        table, at = np.stack(self.rows), np.concatenate(places)
        total = table[at, 0]
        inner = np.ones(len(at), bool)
        inner[np.cumsum(sizes) - sizes] = False  # words with a word of their own text before them
        total[1:][inner[1:]] += table[at[:-1][inner[1:]], 1]
        total[:-1][inner[1:]] += table[at[1:][inner[1:]], 2]
        tags = viterbi_rows(total, sizes, self.model["step"])
        ends = np.cumsum(sizes)
        for q in np.unique(np.searchsorted(ends, np.flatnonzero(tags), side="right")).tolist():
            r, own = held[q], tags[ends[q] - sizes[q] : ends[q]]
            marked = np.flatnonzero(own)
            group: list = []
            wanted, n = set(marked.tolist()), int(marked[-1])
            for i, w in enumerate(_WORD.finditer(texts[r])):
                if group and (i not in wanted or own[i] != own[i - 1]):
                    out[r].append(self.span(TAGS[own[i - 1]], group))
                    group = []
                if i in wanted:
                    group.append(w)
                if i >= n:
                    break
            if group:
                out[r].append(self.span(TAGS[own[n]], group))

    @staticmethod
    def span(kind: str, group: list) -> tuple[str, int, int]:
        """The words' stretch without the marks that end it."""
        end, last = group[-1].end(), group[-1]
        while end > last.start() + 1 and last[0][end - 1 - last.start()] in ".,;:)":
            end -= 1
        return kind, group[0].start(), end


@cache
def decoder() -> Decoder:
    return Decoder()


KINDS = ("email", "ip", "card", "phone")


def apart(more: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Those of `more` that touch no base span, by kind as in TAGS, then start; one sorted pass over each."""
    starts, reach, end = [], [], 0
    for _, a, b in sorted(base, key=lambda x: x[1]):
        end = max(end, b)
        starts.append(a)
        reach.append(end)  # the furthest end of all base spans up to this start
    free = [(k, a, b) for k, a, b in more if not (i := bisect_left(starts, b)) or reach[i - 1] <= a]
    return sorted(free, key=lambda x: (TAGS.index(x[0]), x[1]))


def scan_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_model: one row per row of docs."""
    arrow_limits(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            model = decoder().spans(texts)
            counts: list[list] = [[] for _ in KINDS]
            shas, spans, extra = [], [], []
            for text, more in zip(texts, model, strict=True):
                base = base_spans(text)
                for column, kind in zip(counts, KINDS, strict=True):
                    column.append(sum(k == kind for k, _, _ in base))
                shas.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest())
                added = [("model_" + k, s, e) for k, s, e in apart(more, base)]
                extra.append(len(added))
                spans.append(",".join(f"{k}:{s}:{e}" for k, s, e in [*base, *added]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(extra, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_model"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_model long")


def op9_crf_pii(spark, sf_dir: str) -> DataFrame:
    """Contract query over documents."""
    return scan_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
