"""Subject areas of documents, by label propagation over a graph of sentences, terms and documents.

Nodes. A sentence type is a sentence without its digits, names and first word; documents, sentence types and
terms (words and word pairs) are linked where one holds the other. Two documents are neighbours through
the sentence types they share, two sentence types through a shared term or a shared document.

Propagation. The sentence types of the labelled examples are trusted seeds and stay clamped. In each round,
by joins and partial aggregation over those links, a document takes the labels of its sentences, a sentence
type and its terms take the mean of the documents they stand in, and an unlabelled sentence type takes the
subject its terms vouch for. A link is verified before it carries a label: a term counts only if, after
shrinkage towards the subjects' base rates, one subject holds most of its documents. Words that
stand in every sort of document stay near the base rates and carry nothing.

Result. Every sentence is on at most one subject, a document on each subject that at least
``MIN_SENTENCES`` of its sentences are on: none, one or several.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumencase.functions.arrow import sliced
from lumencase.staging import cut, release, small_enough

#: Sentences on a subject that put a document in it; rounds of propagation at most, if labels keep changing.
MIN_SENTENCES, ROUNDS = 3, 12
#: Terms that a line must have to be a sentence at all (a log line has fewer); two of them must be verified.
MIN_TERMS = 4
#: Documents' worth of base rate mixed into a term's share; how much of the way from a subject's base rate to all of a
#: term's documents verifies the term; lead over the second subject;
#: and the share of a sentence's terms that must be verified for its subject.
SHRINK, PURE, LEAD, COVER = 4.0, 0.4, 1.5, 0.2

#: Sentence types whose terms a task remembers to have given.
REMEMBERED = 500_000

_SPLIT = re.compile(r"(?<=[.!?])[\"'»”*)\]]*\s+")
_TOKEN = re.compile(r"\S*\d\S*|[^\W\d_]+(?:['’-][^\W\d_]+)*")
_INVISIBLE = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
NAME, NUMBER = "@", "#"


def sentences(text: str) -> list[str]:
    """The sentences of a text: split at sentence ends and at line ends, but a wrapped line is joined to the next."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_INVISIBLE)
    lines: list[str] = []
    for line in re.split(r"[\r\n]+", text):
        line = line.strip()
        if not line:
            lines.append("")
        elif lines and lines[-1] and lines[-1][-1] not in ".!?:;]" and line[0].islower():
            lines[-1] += " " + line
        else:
            lines.append(line)
    out = []
    for line in lines:
        out += [s for s in _SPLIT.split(re.sub(r"^(?:[-*>#•]+\s+)+", "", line)) if s.strip()]
    return out


def _masked(sentence: str) -> tuple[str, list[str]]:
    """(the type's text, its plain words): lower case, numbers and inner names masked, the first word left out."""
    masked, plain, last = [], [], ""
    for w in _TOKEN.findall(sentence.replace("*", ""))[1:]:
        if w.islower() and w.isalpha():
            mask = word = w
        elif any(map(str.isdigit, w)):
            mask = word = NUMBER
        else:
            word = w.lower()
            mask = NAME if w[0].isupper() and not w.isupper() else word
        if mask != last or mask not in (NAME, NUMBER):
            masked.append(mask)
        last = mask
        plain.append(word)
    return " ".join(masked), plain


def _terms(plain: list[str]) -> list[str]:
    terms = {w for w in plain if len(w) > 3}
    terms.update(f"{a} {b}" for a, b in zip(plain, plain[1:], strict=False) if NUMBER not in (a, b))
    return sorted(terms)


def sentence_type(sentence: str) -> tuple[str, list[str]]:
    """(the type's text, its terms: words of more than three letters and pairs of words)."""
    key, plain = _masked(sentence)
    return key, _terms(plain)


@lru_cache(maxsize=1 << 17)
def _number(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_LINKS = "owner long, kind long, n int, terms array<long>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """owner, kind (sentence type), n, terms (only where the type is met first in the task, as far as it remembers)."""
    met: set[int] = set()
    for batch in sliced(batches):
        rows = []
        if len(met) > REMEMBERED:
            met.clear()
        for owner, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own: dict[int, list] = {}
            for s in sentences(text):
                key, plain = _masked(s)
                k = _number(key)
                if k in own:
                    own[k][0] += 1
                elif k in met:
                    own[k] = [1, None]
                elif terms := _terms(plain):
                    met.add(k)
                    own[k] = [1, [_number(t) for t in terms]]
            rows += [(owner, k, n, terms) for k, (n, terms) in own.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["owner", "kind", "n", "terms"])


def _graph(rows: DataFrame, id: str) -> DataFrame:
    return rows.where(F.col(id).isNotNull() & F.col("text").isNotNull()).select(F.col(id).cast("long").alias("owner"), F.col("text").cast("string").alias("text")).mapInArrow(_read, _LINKS)


def _near(small: DataFrame, n: int, bytes_per_row: int) -> DataFrame:
    return F.broadcast(small) if small_enough(n, bytes_per_row) else small


def sentence_labels(documents: DataFrame, examples: DataFrame, areas: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(links: owner, kind, n; labels: kind, subject) after propagation.

    The subjects are those of ``areas``; there are few by nature. Examples with an unknown or null subject
    seed nothing; a sentence type whose examples disagree takes the subject of most of them. Rounds end when no label
    changes, after ``rounds`` at the latest.
    """
    names = sorted({r["subject"].strip() for r in areas.select("subject").collect() if r["subject"] and r["subject"].strip()})
    parts = cut(_graph(documents, "doc_id"))
    links = parts.select("owner", "kind", "n")
    if not names:
        return links, links.select("kind", F.lit(None).cast("string").alias("subject")).limit(0)
    index = F.array_position(F.array(*map(F.lit, names)), F.trim("subject")) - 1
    seeds = _graph(examples, "example_id")
    told = examples.select(F.col("example_id").cast("long").alias("owner"), index.cast("int").alias("s")).where("s >= 0")
    seeds = cut(seeds.join(told, "owner"))
    clamped = cut(seeds.groupBy("kind", "s").agg(F.count("*").alias("n")).groupBy("kind").agg(F.max_by("s", F.struct("n", -F.col("s"))).alias("s")))
    # what does not change between rounds: the documents and examples of each type, the terms of each type that could ever be verified
    own = clamped.select("kind", F.lit(1).alias("df"))
    counted = links.groupBy("kind").agg(F.count("*").alias("df")).unionByName(own).groupBy("kind").agg(F.sum("df").alias("df"))
    kinds = parts.where("terms is not null").select("kind", "terms").unionByName(seeds.where("terms is not null").select("kind", "terms"))
    kinds = cut(kinds.groupBy("kind").agg(F.max("terms").alias("terms")).join(counted, "kind"))
    each = kinds.select("kind", "df", F.explode("terms").alias("term"))
    telling = cut(each.groupBy("term").agg(F.sum("df").alias("term_df")).where(F.col("term_df") >= PURE * SHRINK / (1 - PURE)))
    told_terms = each.join(_near(telling.select("term"), telling.count(), 16), "term")
    graph = cut(told_terms.groupBy("kind").agg(F.collect_list("term").alias("told")).join(kinds.select("kind", F.size("terms").alias("terms")), "kind"))
    release(kinds)
    share = [f"d{i}" for i in range(len(names))]
    labels, n_labels, changed = clamped, clamped.count(), None
    for _ in range(rounds):
        # documents take the labels of their sentences; what no sentence vouches for stays near nothing
        per = links.join(_near(labels, n_labels, 16), "kind").groupBy("owner").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("s") == i, F.col("n")).otherwise(0)).alias(d) for i, d in enumerate(share)])
        docs = per.select("owner", *[(F.col(d) / (F.col("n") + 1)).cast("float").alias(d) for d in share])
        # sentence types take the sum over the documents they stand in
        types = cut(links.join(docs, "owner").groupBy("kind").agg(F.count("*").alias("df"), *[F.sum(d).alias(d) for d in share]))
        base = types.agg(*[(F.sum(d) / F.greatest(F.sum("df"), F.lit(1))).alias(d) for d in share]).first()
        base = [float(x or 0.0) for x in base]
        scale = sum(base) or 1.0
        base = [max(b / scale, 1e-3) for b in base]
        # terms: the same over their types; examples count as documents wholly on their subject
        seeded = clamped.select("kind", *[(F.col("s") == i).cast("double").alias(d) for i, d in enumerate(share)])
        shares = types.drop("df").unionByName(seeded).join(graph, "kind").select(F.explode("told").alias("term"), *share).groupBy("term").agg(*[F.sum(d).alias(d) for d in share]).join(telling, "term")
        mass = sum((F.col(d) for d in share), F.lit(0.0))
        shrunk = [(F.col(d) + SHRINK * b) / (mass + SHRINK) for d, b in zip(share, base, strict=True)]
        # verified: one subject holds most of the term's labelled documents, and most of its documents are labelled
        verified = shares.select("term", (mass / F.col("term_df")).alias("told"), *[x.alias(d) for x, d in zip(shrunk, share, strict=True)])
        lead = [(F.col(d) - b) / max(1 - b, 1e-3) for d, b in zip(share, base, strict=True)]
        best = F.greatest(*lead) if len(share) > 1 else F.lit(1.0)
        weights = [F.greatest(F.log(F.col(d) / F.lit(b)), F.lit(0.0)).alias(d) for d, b in zip(share, base, strict=True)]
        verified = cut(verified.where((best >= PURE) & (F.col("told") >= 0.3)).select("term", *weights))
        links_of = graph.select("kind", "terms", F.explode("told").alias("term"))
        votes = links_of.join(_near(verified, verified.count(), 16 + 8 * len(share)), "term").groupBy("kind", "terms").agg(F.count("*").alias("verified"), *[F.sum(d).alias(d) for d in share])
        ranked = F.array_sort(F.array(*[F.struct((-F.col(d)).alias("v"), F.lit(i).alias("s")) for i, d in enumerate(share)]))
        second = F.coalesce(F.try_element_at(F.col("r"), F.lit(2))["v"], F.lit(0.0))
        won = votes.where((F.col("verified") / F.col("terms") >= COVER) & (F.col("terms") >= MIN_TERMS) & (F.col("verified") >= 2)).select("kind", ranked.alias("r")).where((F.col("r")[0]["v"] < 0) & (F.col("r")[0]["v"] * (1 / LEAD) <= second)).select("kind", F.col("r")[0]["s"].alias("s"))
        after = cut(won.join(_near(clamped, n_labels, 16), "kind", "left_anti").unionByName(clamped))
        # rounds end when every label is what it was; sums of the labels' hashes tell
        state = after.agg(F.count("*"), F.sum(F.xxhash64("kind", "s").cast("decimal(38,0)"))).first()
        release(types, verified, labels if labels is not clamped else None)
        labels, n_labels, was, changed = after, state[0], changed, state
        if was == changed:
            break
    release(graph, telling, seeds)
    return links, labels.select("kind", F.element_at(F.array(*map(F.lit, names)), F.col("s") + 1).alias("subject"))


def document_subjects(documents: DataFrame, examples: DataFrame, areas: DataFrame, min_sentences: int = MIN_SENTENCES) -> DataFrame:
    """doc_id, subject, sentences: each subject that at least ``min_sentences`` sentences of the document are on.

    Null and empty texts are on nothing; a repeated sentence counts each time; a repeated row of one doc_id adds up.
    """
    links, labels = sentence_labels(documents, examples, areas)
    return links.join(labels, "kind").groupBy(F.col("owner").alias("doc_id"), "subject").agg(F.sum("n").alias("sentences")).where(F.col("sentences") >= min_sentences)


def composition(documents: DataFrame, examples: DataFrame, areas: DataFrame) -> DataFrame:
    """subject, documents, sentences: how much of the corpus each subject has; documents on several count for each."""
    return document_subjects(documents, examples, areas).groupBy("subject").agg(F.count("*").alias("documents"), F.sum("sentences").alias("sentences"))
