"""Subject areas of documents, by a multi-pattern automaton over weighted terms (problem 10)."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import cached_property

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, spread
from .subject_terms import seeds

#: Labelled documents at most from which the lexicon is grown and calibrated. Term rarity is counted over all documents.
LABEL_SAMPLE = 1200
#: A term is learned if it occurs in so many sentences of so many documents and belongs to one subject this purely.
LEARN_SENTENCES, LEARN_DOCS, LEARN_PURITY = 4, 3, 0.8
#: and if it keeps such company in this share of its sentences; a pair, if this share of one of its words stands in it.
LEARN_ALONE, LEARN_PAIR = 0.25, 0.4
#: A subject is assigned if it is treated by this share of the sentences that treat any.
SUBJECT_SHARE = 0.2
#: Sentence scores from which a sentence treats a subject by itself, tried in calibration.
THRESHOLDS = (1.2, 1.5, 1.8, 2.1, 2.4)
#: Labels that a subject's own threshold must mend against the common one.
LEAST_GAIN = 3

_OPTIONS = re.compile(r"(?:(?:^|\s)[A-E][.)]\s+[^?!\n]{1,90}?(?=\s[A-E][.)]\s|\n|$|[.]\s)[.]?){2,}")
_QUESTION = re.compile(r"\b(?:which|who|what|how would|how many|how much|where)\b", re.I)
#: Characters of a line at most that stands alone without ending a sentence: a menu, a heading, a button.
LONE_LINE = 80
_SENTENCE_END = frozenset(".!?:;,\"”’»)]")
_MARK = "\x1e"
#: For Arrow's regular expressions: what ends a sentence, and what parts words.
_STOP = r"[.!?][\"\x{201d}\x{2019}\x{bb})\]]*(?:[\s\pZ]+|$)|\n+"
_BETWEEN = r"[^\pL\pN\x{1e}]+"


def all_sentences(texts: pa.Array) -> pa.Array:
    """Each text's own sentences in lower case, words parted by single spaces, sentences by a mark; quoted questions and page furniture left out. Null gives null."""

    def own(text: str | None) -> str | None:
        if text is None:
            return None
        if "?" in text:
            text = drop_questions(_OPTIONS.sub("\n", text))
        return drop_lone_lines(text) if "\n" in text else text

    plain = pc.utf8_lower(pa.array([own(t) for t in texts.to_pylist()], pa.string()))
    words = pc.replace_substring_regex(pc.replace_substring_regex(plain, _STOP, f" {_MARK} "), _BETWEEN, " ")
    return pc.binary_join_element_wise("", words, "", " ")


def sentences(text: str) -> str:
    """:func:`all_sentences` of one text."""
    return all_sentences(pa.array([text], pa.string()))[0].as_py()


def drop_lone_lines(text: str) -> str:
    """The text without short lines that end no sentence, continue none and aren't continued: page furniture, of whatever wording."""
    lines = text.split("\n")
    out, before = [], ""
    for k, line in enumerate(lines):
        own = line.strip()
        if own and len(own) <= LONE_LINE and own[-1] not in _SENTENCE_END and (not before or before[-1] in _SENTENCE_END):
            after = lines[k + 1].strip() if k + 1 < len(lines) else ""
            if not after or not after[0].islower():
                out.append("")
                continue
        out.append(line)
        before = own
    return "\n".join(out)


def drop_questions(text: str) -> str:
    """The text without test questions: an interrogative sentence, with the sentence before it if the question is short and refers to that."""
    out, last = [], 0
    at, begin = text.find("?"), 0
    while at >= 0:
        begin = max(begin, *(text.rfind(c, begin, at) + 1 for c in ".!\n"))  # never further back than the question mark before
        m = _QUESTION.search(text, begin, at)
        if m:
            a = m.start()
            before = text[last:a]
            head = before.rstrip()
            if head and head[-1] not in ".!?:\n\"”" and not before.endswith("\n"):
                a = begin  # the question word stands inside the sentence
            elif head and len(text[a:at].split()) < 9 and head[-1] in ".!?":
                a = last + max(head[:-1].rfind(c) for c in ".!?\n") + 1
            out.append(text[last:a])
            last = at + 1
        begin = at + 1
        at = text.find("?", begin)
    return "".join(out) + text[last:] if out else text


def weigh(term: str, sentences_with: int, total: int, purity: float = 1.0) -> float:
    """A term's weight: its purity, less for a term that every second sentence has."""
    rarity = math.log(1 + total / (1 + sentences_with)) / math.log(1 + total) if total else 1.0
    return round(purity * (0.7 + 0.6 * min(1.0, rarity)), 4)


class Lexicon:
    """Terms with their subject and weight, and the score from which a sentence treats a subject by itself, one for all subjects or one for each."""

    def __init__(self, terms: dict[str, tuple[str, float]], threshold: float | dict[str, float]):
        self.terms, self.threshold = terms, threshold
        self.thresholds = threshold if isinstance(threshold, dict) else dict.fromkeys({s for s, _ in terms.values()}, threshold)
        self.names = sorted(terms)
        self.values = [terms[t] for t in self.names]

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Finds all terms in one pass over a text; made where it is first used."""
        made = ahocorasick.Automaton()
        for number, term in enumerate(self.names):
            made.add_word(f" {term} ", (len(term) + 2, number))
        made.add_word(_MARK, None)
        made.make_automaton()
        return made

    def __reduce__(self):
        return Lexicon, (self.terms, self.threshold)

    def found(self, text: str) -> tuple[list[list[int]], list[int]]:
        """Per sentence with any term, the numbers of its terms, of terms that overlap the longer; and all terms, each once a sentence.

        Weights and threshold have no part in it.
        """
        out: list[list[int]] = []
        every: list[int] = []
        now: list[tuple[int, int, int]] = []
        met: set[int] = set()
        for end, hit in self.automaton.iter(text):
            if hit is None:
                if now:
                    out.append([x[2] for x in now])
                    every += met
                    now, met = [], set()
                continue
            size, number = hit
            met.add(number)
            start = end - size + 2
            while now and now[-1][0] >= start:
                now.pop()  # lies within this one
            if not now or now[-1][1] <= start:
                now.append((start, end, number))
        if now:
            out.append([x[2] for x in now])
            every += met
        return out, every

    def scores(self, text: str) -> list[dict[str, float]]:
        """Per sentence with any term, the score of each subject; of terms that overlap the longer counts."""
        return [self._sum(x) for x in self.found(text)[0]]

    def _sum(self, numbers: list[int]) -> dict[str, float]:
        got: dict[str, float] = {}
        for number in numbers:
            subject, weight = self.values[number]
            got[subject] = got.get(subject, 0.0) + weight
        return got

    def shares(self, text: str | None) -> dict[str, float]:
        """Each subject's share of the text's sentences that treat any; see :meth:`shares_of`."""
        return self.shares_of(self.found(sentences(text))[0]) if text else {}

    def shares_of(self, hits: list[list[int]]) -> dict[str, float]:
        """Each subject's share of the sentences that treat any, from the terms found in each.

        A sentence treats a subject if its score reaches the threshold. A lone term does so in a document that treats
        the subject elsewhere too, be it by lone terms in two sentences or more that make a fifth of those with any
        term, or that treats no subject more than so; else it is a borrowed word.
        """
        per = [self._sum(x) for x in hits]
        strong = {s for x in per for s, v in x.items() if v >= self.thresholds[s]}
        often = Counter(s for x in per for s in x)
        strong |= {s for s, n in often.items() if n >= 2 and n >= SUBJECT_SHARE * len(per) - 1e-9}
        strong = strong or often.keys()
        treated = [t for x in per if (t := [s for s in x if s in strong])]
        count = Counter(s for t in treated for s in t)
        return {s: n / len(treated) for s, n in count.items()}

    def subjects(self, text: str | None) -> list[str]:
        """The document's subjects, in name order; none for a null or empty text."""
        return self._enough(self.shares(text))

    def subjects_of(self, hits: list[list[int]]) -> list[str]:
        """The same from the terms found in each sentence."""
        return self._enough(self.shares_of(hits))

    @staticmethod
    def _enough(shares: dict[str, float]) -> list[str]:
        return sorted(s for s, v in shares.items() if v >= SUBJECT_SHARE - 1e-9)


def sentence_grams(text: str) -> list[tuple[set[str], set[str]]]:
    """For each sentence of a text, given as :func:`sentences` gives it, its words and word pairs without digits, which may become terms, and all its grams of up to three words."""
    out = []
    for s in text.split(_MARK):
        words = s.split()
        if words:
            short = set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}
            every = short | {" ".join(w) for w in zip(words, words[1:], words[2:])}
            out.append(({g for g in short if not any(c.isdigit() for c in g)}, every))
    return out


def learn(docs: list[list[tuple[set[str], set[str]]]]) -> dict[str, tuple[str, float]]:
    """The terms grown from the seeds, with subject and purity: words and word pairs that keep company with one subject's terms. ``docs`` as :func:`sentence_grams` gives them.

    Weights aren't made here, since the texts are a sample. A sentence belongs to a subject if its known terms are of that subject alone; terms found so join for a second round.
    """
    n: Counter = Counter()
    in_docs: Counter = Counter()
    for d in docs:
        mine: set[str] = set()
        for short, _ in d:
            n.update(short)
            mine |= short
        in_docs.update(mine)
    known = {t: (s, 1.0) for t, s in seeds()}
    for _ in range(2):
        by: dict[str, Counter] = defaultdict(Counter)
        for d in docs:
            for short, every in d:
                of = {g: known[g][0] for g in every & known.keys()}
                subjects = set(of.values())
                for g in short if of else ():
                    others = {s for k, s in of.items() if k != g and k not in g and g not in k}
                    if len(others) == 1 and len(subjects) <= 1 + (g in of):
                        by[g][next(iter(others))] += 1
                    elif others:
                        by[g][""] += 1
        grown = {}
        for g, c in by.items():
            s, k = c.most_common(1)[0]
            seen, words = sum(c.values()), g.split()
            if not s or seen < LEARN_SENTENCES or in_docs[g] < LEARN_DOCS or k < LEARN_PURITY * seen or len(g) < 3:
                continue
            if any(w in _COMMON for w in words) or k < LEARN_ALONE * n[g]:
                continue
            if len(words) == 2 and n[g] < LEARN_PAIR * min(n[w] for w in words):
                continue  # two words that meet by chance
            grown[g] = (s, k / seen)
        known = {**grown, **{t: (s, 1.0) for t, s in seeds()}}
    return known


#: Words of no subject, which join no term.
_COMMON = frozenset(
    "a an the and or but nor of in on at by for from to with that this these those its it they he she who which what not no never only is are was were be been "
    "has had have than then as if so where when while how there here second time about every each one once another again first last more most some any all many few near into over under after before since "
    "der die das den dem des ein eine einen und oder von zu mit im am auf für über nach bei ist sind war wurde hat "
    "el la los las un una unos de del y o en con por para que se es son fue sobre entre".split()
)


def held_out(terms: dict[str, tuple[str, float]], labelled: list[tuple[str, set[str]]], grams: list[list[tuple[set[str], set[str]]]]) -> list[tuple[list[list[int]], set[str]]]:
    """The terms found in each labelled text, as :meth:`Lexicon.found`, of those only that are known without the labelled texts of its half.

    ``labelled``: texts as :func:`sentences` gives them, with their labels; ``grams``: their :func:`sentence_grams`. So no text has a say in the terms that it is judged by.
    """
    number = {t: k for k, t in enumerate(sorted(terms))}
    out: list[tuple[list[list[int]], set[str]]] = [([], set())] * len(labelled)
    for half in (0, 1):
        known = learn(grams[1 - half :: 2])
        finder = Lexicon({t: terms[t] for t in known if t in terms}, 0.0)
        own = [number[t] for t in finder.names]
        for k in range(half, len(labelled), 2):
            out[k] = [[own[x] for x in s] for s in finder.found(labelled[k][0])[0]], labelled[k][1]
    return out


def calibrated(terms: dict[str, tuple[str, float]], labelled: list[tuple[list[list[int]], set[str]]]) -> Lexicon:
    """The lexicon at the thresholds that agree best with all the labels (F1 over documents and subjects), ties to the lowest. ``labelled`` as :func:`held_out` gives it.

    First one threshold for all subjects is chosen; then each subject may have its own, if that mends ``LEAST_GAIN`` labels or more.
    """

    def agreement(lexicon: Lexicon, hits: list[list[int]], labels: set[str]) -> tuple[int, int]:
        got = set(lexicon.subjects_of(hits))
        return len(got & labels), len(got ^ labels)

    def f1(right: int, wrong: int) -> float:
        return 2 * right / max(1, 2 * right + wrong)

    def total(lexicon: Lexicon, some: list[int]) -> tuple[int, int]:
        both = [agreement(lexicon, *labelled[k]) for k in some]
        return sum(x for x, _ in both), sum(x for _, x in both)

    every = list(range(len(labelled)))
    scored = [(total(Lexicon(terms, t), every), t) for t in THRESHOLDS]
    (right, wrong), start = max(scored, key=lambda x: (round(f1(*x[0]), 9), -x[1]))
    values = [terms[t][0] for t in sorted(terms)]
    chosen = dict.fromkeys(sorted(set(values)), start)
    for subject in chosen:
        some = [k for k, (hits, _) in enumerate(labelled) if any(values[x] == subject for s in hits for x in s)]
        now = total(Lexicon(terms, chosen), some)
        for t in THRESHOLDS:
            then = total(Lexicon(terms, chosen | {subject: t}), some)
            moved = right + then[0] - now[0], wrong + then[1] - now[1]
            if now[1] - then[1] >= LEAST_GAIN and f1(*moved) > f1(right, wrong):
                chosen[subject], (right, wrong), now = t, moved, then
    return Lexicon(terms, chosen)


def term_hits(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, hits, terms, sentences``: :meth:`Lexicon.found` of each document, and how many sentences it has.

    The documents are read once where they lie; the lexicon, some hundred terms, goes to the tasks with the function.
    Null ids and null or empty texts have no rows; repeated rows give repeated rows.
    """
    rows = spread(docs.filter("doc_id is not null and length(text) > 0").select("doc_id", "text"))
    types = [pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()), pa.int32()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [batch.column(0).to_pylist(), [], [], []]
            for own in all_sentences(batch.column(1)).to_pylist():
                hits, terms = lexicon.found(own)
                cols[1].append(hits)
                cols[2].append(terms)
                cols[3].append(sum(1 for x in own.split(_MARK) if x.strip()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "hits", "terms", "sentences"])

    return rows.mapInArrow(work, "doc_id bigint, hits array<array<int>>, terms array<int>, sentences int")


def fitted_with_hits(docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, DataFrame]:
    """The lexicon, and the terms found in every document, kept in the work folder.

    Terms are grown on at most ``LABEL_SAMPLE`` labelled documents, those of lowest hash, on the driver, and the thresholds are calibrated on
    all of them, each judged by terms known without its half; the bound holds whatever the tables' size. How rare a term is, is counted over the sentences
    of all documents. Without labels the seeds alone make the lexicon.
    """
    wanted = labels.filter("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABEL_SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").filter("text is not null").collect()
    rows.sort(key=lambda r: r["doc_id"])
    texts = list(zip(all_sentences(pa.array([r["text"] for r in rows], pa.string())).to_pylist(), (set(r["subjects"]) for r in rows)))
    grams = [sentence_grams(t) for t, _ in texts]
    pure = learn(grams)
    finder = Lexicon(pure, 0.0)
    hits = materialise(term_hits(docs, finder), "subject_hits")
    total = hits.agg(F.sum("sentences")).first()[0] or 0
    met = {r["term"]: r["n"] for r in hits.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    terms = {t: (pure[t][0], weigh(t, met.get(number, 0), total, pure[t][1])) for number, t in enumerate(finder.names)}
    return calibrated(terms, held_out(terms, texts, grams)), hits


def fitted(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """The lexicon of :func:`fitted_with_hits`."""
    return fitted_with_hits(docs, labels)[0]


def shares_of_hits(hits: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, subject, share`` of every subject that a document's sentences treat, from :func:`term_hits` with the same terms."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(doc, s, v) for s, v in sorted(lexicon.shares_of(found).items())]
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=["doc_id", "subject", "share"])

    return hits.select("doc_id", "hits").mapInArrow(work, "doc_id bigint, subject string, share double")


def subject_shares(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, subject, share`` of every subject that a document's sentences treat; rows as :func:`term_hits`."""
    return shares_of_hits(term_hits(docs, lexicon), lexicon)


def assigned(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, subject``, distinct: every subject treated by at least a fifth of the sentences that treat any."""
    return _enough(subject_shares(docs, lexicon))


def assigned_to_all(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`assigned` with the lexicon fitted to the same documents, whose texts are then searched only once."""
    lexicon, hits = fitted_with_hits(docs, labels)
    return _enough(shares_of_hits(hits, lexicon))


def _enough(shares: DataFrame) -> DataFrame:
    return shares.filter(F.col("share") >= SUBJECT_SHARE - 1e-9).select("doc_id", "subject").distinct()
