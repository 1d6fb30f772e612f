"""Defective question-answer pairs, by a linear classifier trained on made-up defects."""

from __future__ import annotations

import difflib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordonlake.llm.language import Languages
from cordonlake.llm.linear import Features, LinearModel, hash_sample, ngrams

DEFECTS = ["empty", "truncated", "refusal", "copies_question", "other_language"]

# Wording of the made-up defects and of harmless additions to good answers.
NOTHING = ["", " ", "\n", "\t", "​", "\xa0", "-", "--", "—", "?", ".", "...", "…", "''", '""', "[]", "{}", "()", "n/a", "N/A", "n.a.", "na", "nil", "null", "NULL", "None", "none", "TBD", "tbd", "(no answer)",
           "<empty>", "(empty)", "<none>", "[no answer]", "no answer", "unknown", "not available", "not applicable", "to be determined", "_", "***", "(blank)", "<null>", "undefined", "NaN"]
OPENERS = ["", "", "I'm sorry, but ", "Sorry, ", "Sorry - ", "Unfortunately, ", "I apologise, but ", "As an AI model, ", "As a language model, ", "Regrettably, ", "Thank you for the question, but ", "Thank you for asking, but ", "Hmm, ", "I am afraid "]
REFUSALS = ["I cannot answer this question", "I can't help with that", "I am not able to assist with this request", "I must decline to answer", "I am unable to provide this information", "I won't discuss this document",
            "this is not something I can help with", "I would prefer not to answer that", "my guidelines do not allow me to discuss this", "I am not allowed to disclose such matters", "you should ask a qualified professional instead",
            "you will have to consult a lawyer", "it is not possible for me to respond here", "giving an answer would go beyond what I am allowed to do", "I have nothing to say on this", "I do not comment on this", "no comment",
            "this topic is off limits for the assistant", "the request was blocked by the safety policy", "the request has been declined by a filter", "requests of this kind are not answered here", "this system does not give legal advice",
            "it would be irresponsible of me to reply to this", "I have been told to keep this to myself", "let us talk about something else", "please do not ask me to interpret contracts", "no reply can be given under the usage policy",
            "only a licensed adviser should reply to this, so I will not", "you are asking for something that I must not share", "I have no way to comment on this", "I refuse to answer", "I don't want to answer"]
REASONS = ["", "", "", " on the {x}", " when it comes to the {x}", " as to the {x}", " at this time", " because it may be confidential", " without further authorisation", " for legal reasons", " here"]
CLOSERS = ["", "", "", " Please contact the owner of the files.", " Is there anything else I can do for you?", " Please rephrase your request.", " Try another question.", " I hope you understand.", " Please ask someone else."]
REFUSALS_ABROAD = ["Ich kann diese Frage leider nicht beantworten.", "Dazu darf ich keine Auskunft geben.", "Es tut mir leid, aber dabei kann ich nicht helfen.", "Je ne peux pas répondre à cette question.", "Je suis désolé, je ne peux pas vous aider.",
                   "No puedo responder a esta pregunta.", "Lo siento, no puedo ayudar con eso."]
ECHOES = ["", "", "", "You ask: ", "The question is: ", "The question is ", "What is asked is ", "This asks ", "So the question here: ", "You would like to know: ", "Your question was: ", "You want to know ", "Question: ", "Asked: "]
ASIDES = ["I cannot find any other value than this one. ", "Sorry to say, clause 4 was left out. ", "Unfortunately, the period is short. ", "As asked, ", "The party refused to comment until 4 May 2019. ", "It could not be disclosed before. ", "To answer this: ", "On the question of {q}: ", "Asked about this, one finds: ", "{q} "]
AFTERS = [" I cannot find any limit other than this one.", " Sorry, the table was cut short.", " I hope that helps.", " See note 4.", " The text says “… as agreed …”.", " [source 12]", " The other party declined to answer."]

_WORD = re.compile(r"[^\W_]+", re.U)
_QUOTED = re.compile(r"“[^”]*”|\"[^\"]*\"|«[^»]*»|\[[^\]]*\]")
_END = re.compile(r"[.!?…][\"”’»)\]]*\s*$|[\])]\s*$")


def frequent_words(pairs: list[tuple[str, str, str]], least: float = 0.02) -> frozenset[str]:
    """Words that at least ``least`` of the pairs have: mostly such that carry no content, in whatever languages there are."""
    seen: dict[str, int] = {}
    for p in pairs:
        for w in {w for x in p for w in _WORD.findall(x.lower())}:
            seen[w] = seen.get(w, 0) + 1
    return frozenset(w for w, n in seen.items() if n >= max(2, least * len(pairs)) and w.isalpha())


class PairReader:
    """Features of pairs, with what was learnt of their languages and of their frequent words."""

    def __init__(self, languages: Languages, frequent: frozenset[str]):
        self.languages, self.frequent = languages, frequent

    def shares(self, texts: list[str]) -> np.ndarray:
        return self.languages.shares([_QUOTED.sub(" ", t or "") for t in texts])

    def features(self, pairs: list[tuple[str | None, str | None, str | None]]) -> list[Features]:
        if not pairs:
            return []
        asked, given = self.shares([q for q, _, _ in pairs]), self.shares([a for _, a, _ in pairs])
        return [pair_features(*p, self.frequent, lq, la) for p, lq, la in zip(pairs, asked, given)]


def pair_features(question: str | None, answer: str | None, quote: str | None, frequent: frozenset[str], lq: np.ndarray, la: np.ndarray) -> Features:
    """Features of one pair; every text may be null or empty. ``lq`` and ``la`` are the shares of the languages of question and answer."""
    q, a, s = question or "", answer or "", quote or ""
    aw, qw, sw = ([re.sub(r"\d", "0", w) for w in _WORD.findall(x.lower())] for x in (a, q, s))
    f: Features = {"answer": 1.0}
    if not aw:
        return {"wordless": 3.0, **f}
    tail = _QUOTED.sub(" ", a).rstrip()
    bare = _WORD.findall(tail.lower())
    f |= {k: 0.7 * v / (1 + len(aw)) ** 0.5 for k, v in ngrams(aw, "w").items()}
    f |= ngrams([w for w in aw[-2:]], "end")
    f["length"] = min(1.0, len(aw) / 40)
    f[f"words{min(len(aw), 12) if len(aw) < 4 else min(len(aw) // 4 * 4, 24)}"] = 1.0
    if len(aw) <= 3:
        f["whole:" + " ".join(aw)] = 2.0
    # truncation: how the answer ends, and how much of it is a sentence
    ended = bool(_END.search(a))
    last = re.split(r"(?<=[.!?:])\s+|\n", a.strip())[-1]
    f[f"ended={ended}"] = 1.0
    f[f"ended={ended} sentence={min(len(last.split()), 12) // 3}"] = 1.0
    f[f"closes:{a.rstrip()[-1:] if not a.rstrip()[-1:].isalnum() else 'x'}"] = 1.0
    if not ended and bare:
        f["loose"] = min(1.0, len(last.split()) / 10)
        f[f"loose function={bare[-1] in frequent}"] = 2.0
        f["loose new"] = float(bare[-1] not in qw and bare[-1] not in sw)
        f[f"loose case={last.split()[-1][:1].isupper()} short={len(bare[-1]) < 4}"] = 1.0
        f[f"loose list={a.lstrip()[:1] in '-*•'}"] = 1.0
        f[f"loose starts={tail.lstrip()[:1].isupper()} verb={sum(w in frequent for w in bare) >= 2}"] = 1.5
    # copies: what the answer adds to the question
    words_q = set(qw)
    new = [w for w in aw if w not in words_q]
    f["new"] = min(1.0, len(new) / 8)
    f[f"new{min(len(new), 8)}"] = 1.0
    shared = len(words_q & set(aw)) / max(1, len(words_q))
    f["of question"] = shared
    f[f"of question={int(shared * 5)} new={min(len(new), 9) // 3}"] = 2.0
    tq, ta = ({x[i : i + 3] for i in range(len(x) - 2)} for x in (" ".join(qw), " ".join(aw)))
    back = len(ta & tq) / max(1, len(ta))
    f[f"from question={int(back * 10)} of={int(10 * len(ta & tq) / max(1, len(tq))) // 3}"] = 2.0
    f["from question"] = back
    blocks = [b for b in difflib.SequenceMatcher(None, qw, aw, autojunk=False).get_matching_blocks() if b.size > 1]
    if blocks:
        covered = sum(b.size for b in blocks) / len(qw)
        after = len(aw) - blocks[-1].b - blocks[-1].size
        f[f"in order={int(covered * 5)} after={min(after, 4)}"] = 4.0
        f[f"in order={int(covered * 5)} new content={min(len([w for w in new if w not in frequent]), 4)}"] = 3.0
    f["from quote"] = len(set(aw) & set(sw)) / len(set(aw))
    # refusals say nothing on what was asked
    content = {w for w in qw if w not in frequent and len(w) > 3}
    on_topic = len(content & set(aw))
    f[f"on topic={min(on_topic, 4)} long={len(aw) > 4}"] = 1.5
    f["digits"] = float(any("0" in w for w in aw))
    f[f"first person={bool({'i', 'me', 'my', 'ich', 'je', 'we', 'us'} & set(aw))} topic={on_topic > 1}"] = 1.5
    # language of the answer, against the question's; short answers tell little
    letters = sum(c.isalpha() for c in tail)
    if len(lq) > 1 and letters and any(c.isalpha() for c in q):
        apart, sure = 1 - float(lq @ la), float(lq.max() * la.max())
        f["other language"] = 5 * apart * min(1.0, letters / 20)
        f[f"other={lq.argmax() != la.argmax()} sure={sure > 0.8} letters={min(letters // 8, 4)}"] = 4.0
    return f


def _truncate(rng: random.Random, answer: str) -> str:
    text = answer.rstrip()
    at = rng.randint(max(8, len(text) // 4), max(9, len(text) - 3))
    if rng.random() < 0.75:
        at = text.rfind(" ", 0, at) if text.rfind(" ", 0, at) > 6 else at
    return text[:at].rstrip(" .!?;:”\"])") + rng.choice(["", "", "", "", ",", " -"])


def _copy(rng: random.Random, question: str, echoes: list[str]) -> str:
    out = question
    how = rng.randrange(7)
    if how == 1:
        out = out.lower()
    elif how == 2:
        out = out.upper()
    elif how == 3:
        out = re.sub(r"[^\w\s]", "", out).lower()
    elif how == 4 and len(out.split()) > 4:
        words = out.split()
        del words[rng.randrange(len(words))]
        out = " ".join(words)
    elif how == 5 and len(out) > 12:
        i = rng.randrange(4, len(out) - 4)
        out = out[:i] + out[i + 1] + out[i] + out[i + 2 :]
    elif how == 6 and rng.random() < 0.4:
        out = out + " " + out
    elif how == 6:
        out = out.rstrip("?.! ") + rng.choice(["", ".", "!", "...", " ?"])
    echo = rng.choice(echoes)
    return echo + (out[:1].lower() + out[1:] if echo and rng.random() < 0.5 else out)


def _made_up(pairs: list[tuple[str, str, str]], spoken: list[int | None], rng: random.Random, wording: dict[str, list[str]]) -> tuple[list[tuple], list[str]]:
    """Pairs with their label: as given, harmlessly changed, and with each kind of defect. ``spoken`` is the language of each pair, None where question
    and answer do not show the same one."""
    by_language: dict[int, list[str]] = {}
    for (_, a, _), lang in zip(pairs, spoken):
        if lang is not None and len(a.split()) > 4:
            by_language.setdefault(lang, []).append(a)
    rows, labels, pool = [], [], []

    def add(q: str, a: str, s: str, label: str) -> None:
        rows.append((q, a, s))
        labels.append(label)

    for (q, a, s), lang in zip(pairs, spoken):
        add(q, a, s, "")
        if len(a.split()) > 2:
            if rng.random() < 0.5:
                add(q, rng.choice(wording["ASIDES"]).format(q=q) + a, s, "")
            if rng.random() < 0.3:
                add(q, a + rng.choice(wording["AFTERS"]), s, "")
            if rng.random() < 0.15 and len(a) < 80:
                add(q, a.rstrip("."), s, "")
            # short answers are good answers: a name, an amount, a date, a list of names
            names = re.findall(r"[Tt]he \w+ \w+|[A-Z]\w+ [A-Z]\w+ [A-Z][\w.]+", a)
            figures = re.findall(r"(?:[A-Z]{3} |[$€])[\d.,]*\d(?: \w+llion)?|\d+ \w+|\d{4}-\d\d-\d\d", a)
            if figures and rng.random() < 0.15:
                add(q, rng.choice(figures) + rng.choice(["", "."]), s, "")
            if names and rng.random() < 0.15:
                add(q, rng.choice(names), s, "")
            pool += names
            if pool and rng.random() < 0.15:
                add(q, "\n".join("- " + rng.choice(pool) for _ in range(rng.randint(2, 5))), s, "")
        if len(a.split()) > 6 and a.lstrip()[:1] not in "-*•":
            add(q, _truncate(rng, a), s, "truncated")
        if rng.random() < 0.5:
            add(q, _copy(rng, q, wording["ECHOES"]), s, "copies_question")
        if rng.random() < 0.5:
            core = rng.choice(wording["REFUSALS"])
            opener = rng.choice(wording["OPENERS"])
            topic = [w for w in _WORD.findall(q) if len(w) > 4] or ["matter"]
            text = opener + (core if opener else core[:1].upper() + core[1:]) + rng.choice(wording["REASONS"]).format(x=rng.choice(topic)) + rng.choice([".", ".", "!", ""]) + rng.choice(wording["CLOSERS"])
            add(q, rng.choice(REFUSALS_ABROAD) if rng.random() < 0.08 else text, s, "refusal")
        if rng.random() < 0.2:
            add(q, rng.choice(wording["NOTHING"]), s, "empty")
        others = [k for k in by_language if lang is not None and k != lang]
        if others and rng.random() < 0.5:
            donor = rng.choice(by_language[rng.choice(sorted(others))])
            part = [x for x in re.split(r"(?<=[.!?]) ", donor) if len(x.split()) > 4]
            add(q, rng.choice(part) if part and rng.random() < 0.5 else donor, s, "other_language")
    return rows, labels


class DefectModel:
    """Classifier of pairs with ``quality``, the F1 of each defect on held-out made-up pairs; ``linear`` is None if nothing could be learnt."""

    def __init__(self, sample: pd.DataFrame, labelled: pd.DataFrame, seed: int = 5):
        """From ``question, answer, quote`` of pairs that are mostly good, and ``text, lang`` of some texts.

        The sample itself holds defects; a first model drops the pairs that it finds before the second is fitted.
        """
        pairs = [(q or "", a or "", s or "") for q, a, s in zip(sample["question"], sample["answer"], sample["quote"]) if (q or "").strip()]
        languages = Languages(labelled)
        self.reader = PairReader(languages, frequent_words(pairs))
        self.linear: LinearModel | None = None
        self.quality: dict[str, float] = {f"language {k}": v for k, v in languages.quality.items()}
        # held-out pairs are made up with wording that the model has not seen, so thresholds suit what is new
        lists = {"NOTHING": NOTHING, "OPENERS": OPENERS, "REFUSALS": REFUSALS, "REASONS": REASONS, "CLOSERS": CLOSERS, "ECHOES": ECHOES, "ASIDES": ASIDES, "AFTERS": AFTERS}
        unseen = {k: v[::4] for k, v in lists.items()}
        known = {k: [x for x in v if x not in unseen[k] or x == ""] for k, v in lists.items()}
        for _ in range(2):
            if len(pairs) < 10:
                return
            lq, la = self.reader.shares([q for q, _, _ in pairs]), self.reader.shares([a for _, a, _ in pairs])
            spoken = [int(x.argmax()) if len(x) and x.argmax() == y.argmax() and x.max() * y.max() > 0.5 else None for x, y in zip(lq, la)]
            rng, parts = random.Random(seed), []
            for hold, wording in ((False, known), (True, unseen)):
                at = [i for i in range(len(pairs)) if (i % 5 == 0) == hold]
                rows, labels = _made_up([pairs[i] for i in at], [spoken[i] for i in at], rng, wording)
                parts.append((self.reader.features(rows), np.array([[label == d for d in DEFECTS] for label in labels], float).reshape(-1, len(DEFECTS))))
            self.linear = LinearModel(DEFECTS).fit(*parts[0])
            self.quality |= self.linear.calibrate(*parts[1])
            scores = self.linear.scores(self.reader.features(pairs))
            pairs = [p for p, s in zip(pairs, scores) if not (s >= self.linear.thresholds).any()]


def fitted(df: DataFrame, id_col: str, question_col: str, answer_col: str, quote_col: str, languages: DataFrame | None = None, sample_rows: int = 2500, language_rows: int = 2000, seed: int = 5) -> DefectModel | None:
    """The model of :func:`defective_pairs` for a table, None for an empty one."""
    rows = _distinct(df, id_col, question_col, answer_col, quote_col)
    sample = hash_sample(rows, "id", sample_rows, seed)
    if not len(sample):
        return None
    labelled = pd.DataFrame({"text": pd.Series(dtype=object), "lang": pd.Series(dtype=object)})
    if languages is not None:
        texts = languages.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\S")).select("lang", "text")
        labelled = hash_sample(texts, "text", language_rows, seed)
    return DefectModel(sample, labelled, seed)


def _distinct(df: DataFrame, id_col: str, question_col: str, answer_col: str, quote_col: str) -> DataFrame:
    return df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("id")).agg(
        F.min(F.struct(F.col(answer_col).alias("answer"), F.col(question_col).alias("question"), F.col(quote_col).alias("quote"))).alias("r")
    ).select("id", "r.question", "r.answer", "r.quote")


def defective_pairs(df: DataFrame, id_col: str, question_col: str, answer_col: str, quote_col: str, languages: DataFrame | None = None, model: DefectModel | None = None, **fit) -> DataFrame:
    """``id, defect, score`` of the pairs that have a defect, at most one each: the one furthest over its threshold.

    The classifier is fitted on at most ``sample_rows`` pairs (:func:`fitted`), those of the smallest hash of the id, and on defects made from them; it
    is applied to every row. Its thresholds are calibrated on held-out made-up pairs. Languages are learnt from ``language_rows`` texts that
    carry a label, and answers are swapped between the languages found; without labels ``other_language`` is not judged.

    Args:
        df: one row per id is judged (of several different ones the smallest answer, null first). Other columns are
            ignored. A null or wordless answer is ``empty``, by rule, whatever the classifier says; rows with a null id are left out.
            With fewer than ten questions there is nothing to fit on, and only wordless answers are found.
        languages: ``text, lang``; labels may be wrong now and then.
        model: from :func:`fitted`; fitted here if not given.
    """
    spark = df.sparkSession
    model = model or fitted(df, id_col, question_col, answer_col, quote_col, languages, **fit)
    if model is None:
        return spark.createDataFrame([], "id string, defect string, score double")
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            features = m.reader.features(list(zip(pdf["question"], pdf["answer"], pdf["quote"])))
            silent = np.array(["wordless" in f for f in features], bool)
            names, found, score = np.full(len(pdf), "empty", object), silent, np.ones(len(pdf))
            if m.linear is not None:
                p = m.linear.scores(features)
                over = (p - m.linear.thresholds) / (1 - m.linear.thresholds)
                best = over.argmax(1)
                score = np.where(silent, 1.0, p[np.arange(len(p)), best])
                names = np.where(silent, "empty", np.array(m.linear.labels, object)[best])
                found = silent | (over[np.arange(len(p)), best] >= 0)
            yield pd.DataFrame({"id": pdf["id"], "defect": names, "score": score})[found]

    return _distinct(df, id_col, question_col, answer_col, quote_col).mapInPandas(judge, "id string, defect string, score double")
