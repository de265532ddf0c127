"""Defects of prompt and response pairs: a response's clauses are tagged by a CRF and added up."""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from .crf import LinearChain
from .endings import CLOSED, FORMULA, ITEM, OPEN_END, breaks_off

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
DEFECTS = ("empty", "truncated", "refusal", "copy", "language")

#: Labelled rows the tagger is fitted on: so many of type refusal and of the other types, those
#: with the least hashes of their keys. The only bounded sample here; every row is tagged.
REFUSAL_ROWS, OTHER_ROWS = 700, 2300
#: Parts of a response that training looks at; tagging looks at all.
TRAIN_PARTS = 8
#: Words of a part that is tagged by itself; longer clauses are cut into several parts.
PART_WORDS = 22
#: Features that rules give, and how many features a part may have: rules, words and pairs of words.
RULES, WIDTH = 64, 17 + 2 * PART_WORDS
#: Words in fewer training clauses than this teach nothing; they would only tell single rows apart.
LEAST_SEEN = 4

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
FENCED = re.compile(r"```.*?(?:```|\Z)", re.S)
SENTENCE = re.compile(r"(?<=[.!?。！？;；])[\"'”’)\]]*\s+|(?<=[。！？；])|\n+")
PLACEHOLDER = re.compile(
    r"^\W*(?:none|null|nil|nan|n\W?a|undefined|unknown|tbd|tba|todo|fixme|xxx+|placeholder|blank|empty|missing|answer|output|response|"
    r"no (?:answer|response|output|reply)|lorem ipsum|insert answer(?: here)?|to be (?:added|filled|determined|done)|your answer here)?\W*$",
    re.I,
)
#: Marks around a response that say nothing themselves.
TAGGED = re.compile(r"<think>.*?</think>|</?(?:think|answer|p|br|div|span)\s*/?>", re.S | re.I)
#: Frequent words that tell the languages of Latin script apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with as are by on from which this be at or was were not it its what how does do why than when under more each can who their an if but only into has have about there".split(),
    "de": "der die das und ist nicht mit den von zu auf ein eine einer dem des sich im für bei nach wird werden auch wir ob dass oder aus sind wie was welche warum hinter nur um ohne als mehr wurde weil wenn über".split(),
    "fr": "le la les de des du et est une un que qui dans pour sur avec ne pas plus par nous au aux en ce cette se sans si afin été car rarement vraiment quel quelle comment pourquoi où sont".split(),
    "es": "el la los las de del y es que en un una para por con no se más su al como sobre sin si porque rara vez qué cómo cuál tras son lo fue está entre ya".split(),
    "it": "il lo la gli le di del della e è che in un una per con non si più su come sono nel alla dei tra".split(),
    "pt": "o a os as do da dos das e é que em um uma para por com não se mais como ao pela são no na".split(),
    "nl": "de het een en van is dat op te in met voor niet zijn aan er ook als bij naar wordt hoe wat waarom".split(),
}
_OF: dict[str, set[str]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _w in _words:
        _OF.setdefault(_w, set()).add(_language)

SCRIPTS = [
    ("zh", re.compile(r"[㐀-䶿一-鿿]")), ("ja", re.compile(r"[぀-ヿ]")), ("ko", re.compile(r"[가-힣]")),
    ("ru", re.compile(r"[Ѐ-ӿ]")), ("ar", re.compile(r"[؀-ۿ]")), ("el", re.compile(r"[Ͱ-Ͽ]")), ("he", re.compile(r"[֐-׿]")),
]

#: Rows of the sample of which damaged copies are made, so that the tagger sees every tag however rare it is:
#: each answer cut off in its last third, and its question as the answer.
DAMAGED_ROWS = 100
#: Our own examples, so that the tagger knows refusals and other languages where the data show none.
SEED_REFUSALS = [
    "I can't answer that.", "I cannot answer this question with what I was given.", "Sorry, I am not able to help.", "I don't know.",
    "The context doesn't contain enough information.", "There is no way to tell from these passages.", "I must decline.",
    "Unfortunately, this is not covered by the text.", "I am unable to say.", "I won't comment on this.", "The sources do not mention it.",
]
SEED_FOREIGN = [
    "Das Modell verringert die Laufzeit auf dem zweiten Datensatz, weil der Speicher nicht reicht.", "Wir prüfen, ob die Gewichtung den Abstand bei langen Texten wirklich bestimmt.",
    "Le modèle réduit la mémoire utilisée pour les textes longs, car la requête ne change plus.", "Les auteurs comparent les deux méthodes sur ce corpus et ne trouvent pas de différence.",
    "El modelo mejora la cobertura en los textos largos, porque la consulta ya no limita el tiempo.", "Comparamos los dos métodos para saber si el índice reduce la tasa de error.",
    "模型在第二个数据集上降低了错误率。", "このモデルは長い文章の誤り率を下げます。", "Модель снижает долю ошибок на длинных текстах.",
]
SEED_ANSWERS = [
    "It improves the score by two points.", "The model cannot run without the cache, which the authors accept.", "Yes.", "No.",
    "The authors do not give the first figure, but they report 12.5 for the second.", "About 40 percent of the rows.",
]


def language(text: str) -> str | None:
    """The language of a text by its script and function words; None where these don't tell."""
    if not text.isascii():
        letters = sum(map(str.isalpha, text)) or 1
        for name, script in SCRIPTS:
            if len(script.findall(text)) > 0.2 * letters:
                return name
    votes: dict[str, float] = {}
    for w in WORD.findall(text.lower()):
        if w in _OF:
            own = _OF[w]
            for name in own:
                votes[name] = votes.get(name, 0.0) + 1.0 / len(own)
    if not votes:
        return None
    n, best = max((n, name) for name, n in votes.items())
    rest = max((m for name, m in votes.items() if name != best), default=0.0)
    return best if n >= 1.5 and n > 1.3 * rest else None


def question_of(prompt: str | None) -> str:
    """What follows the last ``Question:``, else the whole prompt."""
    prompt = prompt or ""
    return prompt[prompt.rfind("Question:") + 9 :].strip() if "Question:" in prompt else prompt.strip()


def clauses(text: str) -> list[str]:
    """Sentences, lines and parts between semicolons; a code block is one clause."""
    out: list[str] = []
    at = 0
    for m in FENCED.finditer(text):
        out += SENTENCE.split(text[at : m.start()])
        out.append(m.group())
        at = m.end()
    out += SENTENCE.split(text[at:])
    return [c.strip() for c in out if c and any(map(str.isalnum, c))]


def is_unfinished(text: str) -> bool:
    """Whether a response ends within a word, sentence, list or code block."""
    body = text.rstrip()
    if body.count("```") % 2:
        return True
    if body.endswith("```"):
        return False
    lines = body.split("\n")
    last = lines[-1]
    if ITEM.match(last):
        items = [x.strip() for x in lines[:-1] if ITEM.match(x)]
        end = last.strip()
        if any(CLOSED.search(x) for x in items):
            return not CLOSED.search(end)
        if CLOSED.search(end):
            return False
        words = end.split()
        if len(words) < 2 or words[-1].lower() in OPEN_END or end[-1] in ",;:-":
            return True
        if re.match(r"\s*\d", last) and not items:
            return True
        sizes = [len(x.split()) for x in items]
        return bool(items) and (len(words) < min(sizes) or all(x[-1] == "s" for x in items) and end[-1] != "s")
    if "=" in last and re.match(r"^[^.!?]{0,30}:\s", last):
        return not (FORMULA.search(last.split(":", 1)[1].strip()) or CLOSED.search(last))
    words = last.split()
    if len(lines) == 1 and len(words) > 1 and not CLOSED.search(last) and re.search(r"[^\W\d_]", last) and not re.search(r"[\])]$", last):
        return True  # a bare figure or name is whole, a few words aren't
    return breaks_off(text) is not None


def clause_features(output: str, question: str) -> tuple[list[str], list[tuple[list[int], list[str]]], list[dict]]:
    """(clauses, features of their parts, what the weak labels need of each) of one response.

    A part's features are the numbers of what rules see in it, and the words and pairs of words it has.

    A clause of more than PART_WORDS words has several consecutive parts, of equal length but for a
    word; each word is in one part and each pair of neighbours in that of its second word.
    """
    own, whole = language(question), language(output)
    same = own is None or whole == own  # then no clause can be foreign
    known = set(WORD.findall(question.lower()))
    open_end = is_unfinished(output)
    found = clauses(output)
    parts: list[tuple[str, list[str], list[str]]] = []  # text, words, words with the one before
    for clause in found:
        lower = clause.lower()
        at = [m.span() for m in WORD.finditer(lower)]
        if len(at) <= PART_WORDS:
            words = [lower[a:b] for a, b in at] or [clause]
            parts.append((clause, words, words))
            continue
        n = -(-len(at) // PART_WORDS)
        for k in range(n):
            a, b = len(at) * k // n, len(at) * (k + 1) // n
            words = [lower[i:j] for i, j in at[max(0, a - 1) : b]]
            parts.append((lower[at[a][0] : at[b - 1][1]], words[a > 0 :], words))
    facts, numbers = [], []
    for i, (part, words, linked) in enumerate(parts):
        echo = sum(w in known for w in words) / len(words)
        spoken = whole if same else language(part) or whole
        foreign = bool(not same and spoken and spoken != own)
        last = i == len(parts) - 1
        facts.append({"echo": echo, "foreign": foreign, "open": last and open_end, "words": len(words)})
        f = [1, 2 + min(9, int(echo * 10)), 14 + foreign, 16 + (2 if last and open_end else 1 if last else 0)]
        f += f[1:] * 3  # what is told by a rule weighs more than any word
        if len(words) >= 5 and echo >= 0.75:
            f += 4 * [33]
        # Words count by their language and whether it is the question's, lest a language itself tells.
        tongue = f"{spoken}{foreign:d} "
        numbers.append((f, [tongue + w for w in words] + [f"{tongue}{a} {b}" for a, b in zip(linked, linked[1:])]))
    return found, numbers, facts


def weak_tags(facts: list[dict], kind: str) -> list[int]:
    """Tags of a training row from its type and from what can be seen in each clause."""
    out = []
    for x in facts:
        if x["foreign"]:
            out.append(FOREIGN)
        elif x["open"]:
            out.append(UNFINISHED)
        elif x["echo"] >= 0.75 and x["words"] >= 4:
            out.append(ECHO)
        else:
            out.append(REFUSAL if kind == "refusal" else ANSWER)
    return out


class Tagger:
    """A fitted chain and the words it knows; a word it has not learned says nothing."""

    def __init__(self, chain: LinearChain, vocabulary: dict[str, int]):
        self.chain, self.vocabulary = chain, vocabulary

    def decode(self, parts: list[tuple[list[int], list[str]]]) -> list[int]:
        """The tags of a response's parts.

        What makes a refusal is its words, so a part without a word that was learned is none.
        """
        known = [[self.vocabulary[w] for w in words if w in self.vocabulary] for _, words in parts]
        barred = [(t, REFUSAL) for t, k in enumerate(known) if not k]
        return self.chain.decode([rules + k for (rules, _), k in zip(parts, known)], barred)

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            pickle.dump(self, f)

    @staticmethod
    def load(path: str) -> Tagger:
        """A tagger saved before; only from files of your own, as for any pickle."""
        with open(path, "rb") as f:
            return pickle.load(f)


def fit_tagger(rows: list[tuple[str, str, str]]) -> Tagger:
    """A tagger from labelled rows (type, prompt, output); refusals the data label teach refusal."""
    examples = [(k, question_of(q), o) for k, q, o in rows if o and any(map(str.isalnum, o))]
    examples += LEAST_SEEN * [("refusal", "What does the model change?", o) for o in SEED_REFUSALS]
    plain = [(k, q, o) for k, q, o in examples if k != "refusal" and len(o) > 30][:DAMAGED_ROWS]
    examples += [(k, q, o[: len(o) * 5 // 6].rstrip()) for k, q, o in plain] + [(k, q, q) for k, q, _ in plain]
    examples += LEAST_SEEN * [("grounded", "What does the model change?", o) for o in SEED_ANSWERS]
    examples += 2 * LEAST_SEEN * [("grounded", "What does the model change in the table of results?", o) for o in SEED_FOREIGN]
    spoken = Counter(language(q) for _, q, _ in examples)
    usual = spoken.most_common(1)[0][0]
    made = []
    for kind, question, output in examples:
        _, parts, facts = clause_features(output, question)
        if language(question) not in (usual, None) or language(output) not in (usual, None) and not any(x["foreign"] for x in facts):
            continue  # too few to tell a refusal's words from the language's
        if parts:
            made.append((parts[-TRAIN_PARTS:], weak_tags(facts, kind)[-TRAIN_PARTS:]))
    counts = Counter(w for parts, _ in made for _, words in parts for w in words)
    vocabulary = {w: RULES + i for i, w in enumerate(sorted(w for w, n in counts.items() if n >= LEAST_SEEN))}
    time = max(len(parts) for parts, _ in made)
    x, y = np.zeros((len(made), time, WIDTH), np.int64), np.zeros((len(made), time), np.int64)
    for i, (parts, tags) in enumerate(made):
        for t, (rules, words) in enumerate(parts):
            f = rules + [vocabulary[w] for w in words if w in vocabulary]
            x[i, t, : len(f)] = f
        y[i, : len(tags)] = tags
    chain = LinearChain(len(TAGS), RULES + len(vocabulary)).fit(x, y, np.array([len(parts) for parts, _ in made]), steps=120)
    return Tagger(chain, vocabulary)


def pair_defect(kind: str | None, prompt: str | None, output: str | None, tagger: Tagger) -> str | None:
    """The defect of one pair, None for a sound one.

    The words of the tagged clauses decide: mostly foreign is ``language``; an echo without an
    answer is ``copy``; a refusal of at least three tenths is ``refusal`` unless the type is refusal
    or unknown (a limit that is named before an answer is tagged as answer); else an unfinished last clause is ``truncated``.
    """
    output = None if output is None else TAGGED.sub("", output)
    if output is None or not any(map(str.isalnum, output)) or PLACEHOLDER.match(output):
        return "empty"
    found, numbers, facts = clause_features(output, question_of(prompt))
    tags = tagger.decode(numbers)
    cover = [0] * len(TAGS)
    for tag, x in zip(tags, facts):
        cover[tag] += x["words"]
    total = sum(cover) or 1
    if cover[FOREIGN] > 0.5 * total:
        return "language"
    # A frame around the question, of a few words, isn't an answer.
    if cover[ECHO] and cover[ANSWER] + cover[REFUSAL] + (cover[UNFINISHED] if len(found) > 1 else 0) <= 0.25 * cover[ECHO]:
        return "copy"
    if tags[-1] == UNFINISHED:
        return "truncated"
    if cover[REFUSAL] >= 0.3 * total and kind not in ("refusal", None):
        return "refusal"
    return None


def labelled_sample(rows: DataFrame, key: str) -> list[tuple[str, str, str]]:
    """The rows a tagger is fitted to, of a table with kind, prompt and output: see REFUSAL_ROWS."""
    labelled = rows.where("kind is not null and output is not null").withColumn("h", F.xxhash64(key))
    out = []
    for condition, n in (("kind = 'refusal'", REFUSAL_ROWS), ("kind <> 'refusal'", OTHER_ROWS)):
        least = labelled.where(condition).orderBy("h", "output").limit(n)
        out += [(r["kind"], r["prompt"], r["output"]) for r in least.collect()]
    return out


def broken_pairs(
    df: DataFrame, key: str = "qa_id", kind: str = "type", prompt: str = "input", output: str = "output", tagger: Tagger | None = None
) -> DataFrame:
    """(key, defect): one row for each defective pair, by ``tagger`` or one that is fitted to ``df``.

    Types are compared without case and outer blanks; a null or blank type counts as unknown, so
    such a row is never a ``refusal``. A null prompt asks nothing, so nothing can echo it. Null
    keys are left out, rows that repeat a key count once, with the least defect of theirs if they
    differ. Texts of any length are read whole. Other columns are not read. An empty table gives
    no rows.
    """
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key), F.nullif(F.lower(F.regexp_replace(kind, r"^\s+|\s+$", "")), F.lit("")).alias("kind"), F.col(prompt).alias("prompt"), F.col(output).alias("output")
    )
    # A fitted tagger has a bounded size, whatever the data: the words of its bounded sample.
    sent = df.sparkSession.sparkContext.broadcast(tagger or fit_tagger(labelled_sample(rows, key)))
    id_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            found = [pair_defect(*(x.as_py() for x in row), own) for row in zip(b.column(1), b.column(2), b.column(3))]
            at = pa.array([i for i, d in enumerate(found) if d], pa.int64())
            if len(at):
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([d for d in found if d])], names=[key, "defect"])

    return spread(rows).mapInArrow(run, f"`{key}` {id_type}, defect string").groupBy(key).agg(F.min("defect").alias("defect"))
