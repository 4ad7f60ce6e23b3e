"""Template residue, filler and error pages: a linear classifier from weak labels.

Two kinds of passages are classified: whole texts, and spots, that is what stands between
brackets or between two equal signs, where an unfilled field may be.  Status codes and a few
phrases and field styles give weak labels: surely residue, surely content, or neither.  A
regularised linear classifier on hashed n-grams, shapes, length and title features learns each
kind from a bounded sample of labelled passages, without the hosts held out for validation.
Its score decides: a document is residue if its text or one of its spots has a probability of
``sure`` or ``sure_field`` or more.
What styles, phrases and languages the labels don't know it finds by what they share with those
the labels know.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screeline.llm.hashed import WORD, codes, decoded, named
from screeline.llm.linear import Linear, Rows, fit

BUCKETS = 1 << 18

# fixed values: weak labels of whole texts; a text of at most SHORT words is residue if it
# holds a response status or one of few phrases
SHORT = 40
TEXT_SEEDS = {
    "status": r"(?i)\b(?:http|status|error|code|fehlercode)\W{0,3}(?:error\W{0,2})?[45]\d\d\b|\A\W*[45]\d\d\b|\([45]\d\d\)",
    "script": r"(?i)\b(?:enable|activate|turn on|activer|aktivieren|active)\b.{0,20}\bjavascript\b",
    "denied": r"(?i)\baccess denied\b|\bforbidden\b",
    "trace": r"(?i)\btraceback\b|\bundefined variable\b|\bexception in\b",
    "gateway": r"(?i)\bbad gateway\b|\bgateway timeout\b|\btoo many requests\b",
    "latin": r"(?is)\blorem\b.*\b(?:sit|sed|amet)\b",
    "gone": r"(?i)\bno longer available\b|\bcould not be found\b|\bnicht gefunden\b|\bintrouvable\b",
}
# fixed values: words with which a text is no sure content
OPEN_WORDS = r"(?i)javascript|cookies|browser|\berror\b|\b[45]0\d\b|lorem|not found|denied|placeholder|template|undefined|scripts?\b"
# fixed values: weak labels of spots, field styles of template engines and editors
FIELD_SEEDS = {
    "double braces": r"\A\{\{.*\}\}\Z",
    "dollar brace": r"\A\$\{.*\}\Z",
    "single brace": r"\A\{[a-z]{2,}(?:_[a-z]+)*\}\Z",
    "percent round": r"\A%\(.*\)s\Z",
    "percent angle": r"\A<%.*%>\Z",
    "percent brace": r"\A\{%.*%\}\Z",
    "insert here": r"(?i)\A\[\s*insert\s.*here\s*\]\Z",
    "your angle": r"(?i)\A<\s*your\s.*>\Z",
    "capital angle": r"\A<[A-Z]{3,}(?:\s[A-Z]+)*>\Z",
    "round here": r"(?i)\A\((?:add|insert|enter|put|your)\s.*here\)\Z",
}
# fixed values: what asks a writer to fill something in
ASKING = r"(?i)\b(?:add|insert|enter|put|your|here|goes|fill|filled)\b"
# fixed values: tags that are markup
TAGS = r"(?i)\A</?(?:a|b|i|u|s|p|br|hr|em|li|ul|ol|td|tr|th|div|pre|sub|sup|span|code|table|strong|small|blockquote|img|h\d)\b[^<>]*>\Z"

_PIECE = re.compile(r"[^\W\d_]+|\d+")
# a spot reaches from an opening sign to its closing one, or between equal signs around a name
_SPOT = re.compile(
    r"(?<!\{)[$#%@]?\{++[^{}]*+\}++|(?<!\[)\[++[^\[\]]*+\]++|(?<!<)<++[^<>]*+>++|(?<!\()%?\(++[^()]*+\)++s?|«[^«»]*+»(?:\s*:(?:\s+\w+){1,4})?"
    r"|(?<![$%@#~|!?*=\w])([$%@#_~|!?*=]{1,2})[^\W_]++(?:[._][^\W_]++)*+\1"
)
_SIGN = re.compile(r"[{\[<(«$%@#_~|!?*=]")
_GENERAL = str.maketrans({**dict.fromkeys("{[<(«", "("), **dict.fromkeys("}]>)»", ")"), **dict.fromkeys("$%@#~|!?*=_", "#")})
_text_seeds = {k: re.compile(v) for k, v in TEXT_SEEDS.items()}
_field_seeds = {k: re.compile(v, re.S) for k, v in FIELD_SEEDS.items()}
_open, _asking, _tags = re.compile(OPEN_WORDS), re.compile(ASKING), re.compile(TAGS, re.S)
_letters = re.compile(r"[^\W\d_]{2}")


def _hash(name: str) -> int:
    return named(name) % BUCKETS


#: Bounds of the length features, in words.
LENGTHS = (6, 12, 24, 48, 96)
_bounds = {b: (_hash(f"from {b}"), _hash(f"under {b}")) for b in LENGTHS}


def words_of(text: str) -> tuple[list[str], int, float]:
    """The words of a decoded text in lower case, their number and the share of different ones."""
    words = WORD.findall(text.lower())
    return words, len(words), len(set(words)) / max(len(words), 1)


def text_features(texts: list[str], split: list[tuple[list[str], int, float]] | None = None) -> Rows:
    """Words, word pairs, length, variety and title of whole decoded texts; ``split`` are their
    words if they are known."""
    words, size, extra = [], [], []
    for t, (w, n, varied) in zip(texts, split or map(words_of, texts)):
        first = t[: t.find("\n")] if "\n" in t else t
        head = first.rstrip()[-1:]
        words.extend(w)
        size.append(n)
        # the length says of each bound whether it is under it: lengths not seen in the fit lie beside seen ones
        extra.append((*(_bounds[b][n < b] for b in LENGTHS), _hash(f"variety {int(8 * varied)}"), _hash(f"title {min(8, first.count(' ') + 1)} {head in '.!?:'}")))
    size = np.array(size, np.int64)
    code = codes(words)
    owner = np.repeat(np.arange(len(texts)), size)
    together = owner[1:] == owner[:-1]
    pair = ((code[:-1] * 1_000_003 + code[1:] * 7_919) >> 7)[together] % BUCKETS
    # per text: its words, its pairs, its measures
    pairs = np.maximum(size - 1, 0)
    more = len(LENGTHS) + 2
    total = size + pairs + more
    begin = np.concatenate([[0], np.cumsum(total)])
    flat = np.zeros(int(begin[-1]), np.int64)
    within = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    flat[begin[:-1][owner] + within] = code % BUCKETS
    flat[begin[:-1][owner[:-1][together]] + size[owner[:-1][together]] + within[:-1][together]] = pair
    for j in range(more):
        flat[begin[:-1] + size + pairs + j] = [e[j] for e in extra]
    return Rows(flat, begin)


def spots(text: str) -> list[str]:
    """What stands in brackets or between equal signs in a decoded text, and what stands so
    within round or square brackets."""
    found = []
    if _SIGN.search(text):
        for m in _SPOT.finditer(text):
            found.append(m.group())
            if found[-1][0] in "([":
                found += spots(found[-1].strip("()[]"))
    return found


def spot_features(spot: str) -> list[int]:
    """Shape with its signs and with kinds of signs, case, joints, openings, words and word pairs.

    In a shape w stands for a word, a for one letter, 9 for digits, and words that follow each
    other, whatever joins them, are w+w."""
    inside = re.sub(r"\A\W*|\W*\Z", "", spot.strip("_"))
    kind = _PIECE.sub(lambda m: "9" if m.group()[0].isdigit() else "a" if len(m.group()) == 1 else "w", " ".join(spot.split()))
    shape = re.sub(r"w(?:[ ._]w)+", "w+w", kind)
    core = re.sub(r"\A[^\w+]*|[^\w+]*\Z", "", shape.replace("_", " ").strip())
    words = [w.lower() for w in _PIECE.findall(spot)]
    case = "upper" if inside.isupper() else "lower" if inside.islower() else "mixed"
    joint = "_" if "_" in inside else "." if re.search(r"\w\.\w", inside) else " " if " " in inside else ""
    left = re.match(r"[^\w\s]*_*", spot).group()
    right = re.search(r"_*[^\w\s]*\Z", spot).group()
    names = [
        f"shape {shape}", f"general {shape.translate(_GENERAL)}", f"core {core}", f"core {core} {case}", f"left {left}", f"right {right}", f"case {case}{joint}",
        f"depth {min(len(left), 3)} {min(len(right), 3)}", f"kind {len(left)} {case}{joint}", f"words {min(len(words), 8)}",
    ]
    names += [f"word {w}" for w in words] + [f"pair {a} {b}" for a, b in zip(words, words[1:])]
    return [_hash(n) for n in names]


def text_family(text: str, n: int, varied: float) -> str | None:
    """The weak label of a whole decoded text: a family of residue, 'content', or None."""
    if 0 < n <= SHORT:
        for name, seed in _text_seeds.items():
            if seed.search(text):
                return name
        if n >= 4 and varied < 0.3:
            return "repeats"
    if n >= 12 and varied > 0.5 and not _open.search(text) and not any(spot_family(s) not in (None, "content") for s in spots(text)):
        return "content"
    return None


def spot_family(spot: str) -> str | None:
    """The weak label of a spot: a style of fields, 'content', or None."""
    for name, seed in _field_seeds.items():
        if seed.search(spot):
            return name
    if _tags.match(spot) or not _letters.search(spot):
        return "content"
    if spot[0] in "([" and not _asking.search(spot.split(":")[0]) and (spot[0] == "(" or ":" in spot):
        return "content"
    if spot[0] in "*~!?|":
        return "content"
    return None


@dataclass(frozen=True)
class Learning:
    """The sample: at most about ``documents`` documents are read for the fit, of their texts
    labelled content about ``content`` are used, and never more than ``passages`` texts and spots
    in all (those with the least hashes); the share ``held_out`` of the hosts is for validation.  Spots without a weak label that a fit gives a
    probability beyond ``confident`` (or under its rest) are labels of the next, the last being
    the third.
    ``penalty`` is the classifier's; the priors are the weights of all residue in the fits: one
    text in eight, as residue is rare, and one spot in two."""

    documents: int = 100_000
    content: int = 10_000
    passages: int = 100_000
    held_out: float = 0.2
    confident: float = 0.75
    penalty: float = 1e-4
    text_prior: float = 0.125
    spot_prior: float = 0.5


@dataclass(frozen=True)
class Residue:
    """The classifiers of texts and spots; without a sample of both labels one scores nothing."""

    text: Linear | None
    spot: Linear | None


_SAMPLE = "kind string, family string, host double, hash long, features array<int>"


def _narrow(documents: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """(doc, text, draw, host): documents with a text; draw and host are numbers in [0, 1) of the
    document and of its host, or of the document where the host is null."""
    doc = F.col(f"`{doc_id}`")
    owner = F.coalesce(F.col(f"`{host}`").cast("string"), F.concat(F.lit("row "), doc.cast("string")))
    part = lambda salt, c: (F.pmod(F.xxhash64(F.lit(salt), c), F.lit(1_000_000)) / 1_000_000)
    rows = documents.select(doc.alias("doc"), F.col(f"`{text}`").alias("text"), part("draw", doc).alias("draw"), part("host", owner).alias("host"))
    return rows.filter(F.length(F.trim("text")) > 0)


def _labelled(content: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decoded(t) for t in b.column("text").to_pylist()]
            docs = b.column("doc").to_pylist()
            hosts = b.column("host").to_pylist()
            out: list[tuple] = []
            for i, t in enumerate(texts):
                own = lambda name: named(f"{docs[i]} {name}")
                split, own_hash = words_of(t), own("text")
                used = own_hash < content * 2**32
                # a text of more words is content or nothing, and content is used by its hash
                family = text_family(t, *split[1:]) if used or split[1] <= SHORT else None
                if family and (family != "content" or used):
                    out.append(("text", family, hosts[i], own_hash, text_features([t], [split]).features.tolist()))
                for j, s in enumerate(spots(t)):
                    out.append(("spot", spot_family(s), hosts[i], own(j), spot_features(s)))
            columns = list(zip(*out)) if out else [(), (), (), (), ()]
            types = (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["kind", "family", "host", "hash", "features"])

    return run


def weak_sample(rows: DataFrame, how: Learning) -> list:
    """The labelled texts and the spots of the sample, on the driver: at most ``passages``."""
    count = rows.count()
    if not count:
        return []
    drawn = rows.filter(F.col("draw") < min(1.0, how.documents / count))
    share = min(1.0, how.content / min(count, how.documents))
    return drawn.select("doc", "text", "host").mapInArrow(_labelled(share), _SAMPLE).orderBy("hash", "kind", "features").limit(how.passages).collect()


def _fitted(sample: list, kind: str, how: Learning, unknown: str | None = None) -> Linear | None:
    """The classifier of one kind; ``unknown`` is a family whose labels it may not use."""
    mine = [r for r in sample if r["kind"] == kind]
    rows = Rows.of([r["features"] for r in mine])
    label = np.array([np.nan if r["family"] in (None, unknown) else float(r["family"] != "content") for r in mine])
    for turn in range(3):
        at = np.flatnonzero(~np.isnan(label))
        if not (label[at] == 1).any() or not (label[at] == 0).any():
            return None
        model = fit(rows.take(at), label[at], BUCKETS, penalty=how.penalty, prior=how.text_prior if kind == "text" else how.spot_prior)
        open_ = np.flatnonzero(np.isnan(label))
        if turn == 2 or not len(open_):
            break
        score, far = model.scores(rows)[open_], np.log(how.confident / (1 - how.confident))
        label[open_] = np.where(score > far, 1.0, np.where(score < -far, 0.0, np.nan))
    return model


def learn(sample: list, how: Learning) -> Residue:
    """The classifiers, from the passages of hosts that aren't held out."""
    seen = [r for r in sample if r["host"] >= how.held_out]
    return Residue(_fitted(seen, "text", how), _fitted(seen, "spot", how))


def find_residue(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "route_id", how: Learning = Learning(), sure: float = 0.6, sure_field: float = 0.5) -> DataFrame:
    """(doc_id, residue, field): the documents to exclude, with the greatest probability that the
    classifiers give to the text or one of its spots, and whether a spot is taken for a field.

    A document is in the result if its text has at least the probability ``sure`` or a spot has
    ``sure_field``; no list decides.  Null, empty and blank texts are no cases; repeated rows of a document give one
    row; in an empty table, or one whose weak labels are all alike, nothing is found.  Columns
    other than the named ones are ignored.
    """
    spark = documents.sparkSession
    rows = _narrow(documents, doc_id, text, host)
    model = spark.sparkContext.broadcast(learn(weak_sample(rows, how), how))  # two arrays of a megabyte
    least, least_field = (float(np.log(p / (1 - p))) for p in (sure, sure_field))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            texts = [decoded(t) for t in b.column("text").to_pylist()]
            score = np.full(len(texts), -np.inf)
            if m.text:
                score = m.text.scores(text_features(texts))
            spot = np.full(len(texts), -np.inf)
            if m.spot:
                found = [(i, spot_features(s)) for i, t in enumerate(texts) for s in spots(t)]
                np.maximum.at(spot, [i for i, _ in found], m.spot.scores(Rows.of([f for _, f in found])))
            keep = np.flatnonzero((score >= least) | (spot >= least_field))
            chance = 1 / (1 + np.exp(-np.maximum(score, spot)[keep]))
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(keep)), pa.array(chance), pa.array(spot[keep] >= least_field)], ["doc", "residue", "field"])

    found = rows.select("doc", "text").mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, residue double, field boolean")
    found = found.groupBy("doc").agg(F.max("residue").alias("residue"), F.max("field").alias("field"))
    return found.select(F.col("doc").alias(doc_id), F.round("residue", 6).alias("residue"), "field")


def validate(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "route_id", how: Learning = Learning(), sure: float = 0.6, sure_field: float = 0.5) -> DataFrame:
    """(kind, family, rows, agreed, without): of the labelled passages of hosts that the fit did
    not see, how many the classifier puts on their label's side, and of all of the family's
    passages the share that a classifier finds which was fitted without that family's labels."""
    sample = weak_sample(_narrow(documents, doc_id, text, host), how)
    model = learn(sample, how)
    out = []
    for kind, fitted, p in (("text", model.text, sure), ("spot", model.spot, sure_field)):
        least = float(np.log(p / (1 - p)))
        for family in sorted({r["family"] for r in sample if r["kind"] == kind and r["family"]}):
            mine = [r for r in sample if r["kind"] == kind and r["family"] == family]
            unseen = [r for r in mine if r["host"] < how.held_out]
            right = lambda m, rows, side=family != "content", least=least: int(((m.scores(Rows.of([r["features"] for r in rows])) >= least) == side).sum()) if m else 0
            without = None
            if family != "content":
                other = _fitted([r for r in sample if r["host"] >= how.held_out], kind, how, family)
                without = right(other, mine) / len(mine)
            out.append((kind, family, len(unseen), right(fitted, unseen), without))
    return documents.sparkSession.createDataFrame(out, "kind string, family string, rows long, agreed long, without double")
