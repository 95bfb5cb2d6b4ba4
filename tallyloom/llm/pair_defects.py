"""Broken prompt and response pairs: clauses tagged by a conditional random field, pairs judged by clause coverage.

Every response is cut into clauses; a linear-chain conditional random field tags each as answer, refusal, echo, foreign or
unfinished. Its features compare the clause with the question and the text given in the prompt, count function words by
language, look for value shapes, weigh the clause's words and word pairs by how much they are those of refusals, and ask
whether a clause without a final mark ends like clauses that do have one (a table of clause frames counted over the whole
corpus). There are no labelled pairs. The wording of refusals is learned from the corpus: where a date or a yes or no is
asked for, a whole sentence without a value that repeats neither question nor text declines to answer; made-up
refusals join these. The field is trained on a bounded sample with known damage: responses cut at random places, questions
and given texts put in place of responses, refusals, and texts in other languages. A pair's defect follows from the words
that its tags cover.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.runtime import cut_lineage, spread

TAGS = ["answer", "refusal", "echo", "foreign", "unfinished"]
#: Bound of the training sample, in pairs.
TRAIN_PAIRS = 3000
#: Bound of the sentences that decline to answer, for training.
TRAIN_DECLINED = 2000
#: Clauses of a training response at most; responses to be judged may have any number.
LONGEST = 12
#: Clause frames up to which their table is broadcast (a frame is under 100 bytes).
BROADCAST_FRAMES = 300_000

# fixed values: contents that say nothing
PLACEHOLDERS = {"null", "none", "nil", "nan", "na", "n/a", "n.a.", "n a", "tbd", "tba", "todo", "undefined", "missing", "unknown", "not available", "not applicable", "no answer", "keine angabe", "k.a.", "entfällt"}
# fixed values: function words by language
ENGLISH = set("the a an of to in and or for with by on at from is are was be it its this that these those which who may not as than also after before until gives sets has have must shall can their there into".split())
FOREIGN = {
    "de": "der die das den dem des ein eine einer eines einem einen und oder nicht ist sind wird werden für von mit auf im zum zur durch bis kein keine ab nach über sich bei ja nein wahr falsch als wie dass",
    "fr": "le la les des du un une et est dans pour par que qui ce cette au aux en dès jusqu jusqu'en je ne pas sur avec aucune aucun oui non vrai faux il elle sont",
    "es": "el la los las del un una y es en para por que hasta de se con al sí si verdadero falso ninguna ninguno",
    "it": "il lo la gli le dei degli della delle del nel nella sul sui sugli alla alle un una e è per che di al dal fino con si sì vero falso nessuna nessun",
    "nl": "de het een van en op voor met tot te dat zijn worden wordt niet geen ja nee waar onwaar",
    "pt": "o os as do da dos das um uma e é para por que até com não sim se ao verdadeiro falso nenhuma",
}
MONTHS_EN = "january february march april may june july august september october november december".split()
MONTHS_FOREIGN = set(
    "januar jänner februar märz mai juni juli oktober dezember janvier février mars avril juin juillet août septembre octobre novembre décembre "
    "enero febrero marzo abril mayo junio julio agosto septiembre setiembre octubre noviembre diciembre gennaio febbraio aprile maggio giugno luglio settembre ottobre dicembre "
    "januari februari maart mei augustus janeiro fevereiro março maio junho julho setembro outubro novembro dezembro".split()
)
FOREIGN_WORDS = set(w for v in FOREIGN.values() for w in v.split()) - ENGLISH
# "per" and the like are English as well
FOREIGN_WORDS -= {"per", "non", "no"}
ELISIONS = ("l'", "d'", "dell'", "all'", "nell'", "sull'", "qu'", "jusqu'")
ALONE_FOREIGN = {"non", "nein", "ja", "nee", "oui", "sí", "sì", "si", "não", "sim", "wahr", "falsch", "vrai", "faux", "vero", "falso", "verdadero", "verdadeiro", "waar", "onwaar"}

_TOKEN = regex.compile(r"[\p{L}\p{M}']+|\p{N}+")
_CLAUSE = regex.compile(r"(?<=[.!?;:…])\s+|\s*\n\s*")
_VISIBLE = regex.compile(r"[\p{L}\p{N}]")
_WRAP = regex.compile(r"^[\s\p{Z}\p{C}\"'„“”«»*`_#>\-•]+|[\s\p{Z}\p{C}\"'„“”«»*`_]+$")
_DONE = regex.compile(r"(?<!\.\.)(?<!…)[.!?]$")
_BROKEN_OFF = regex.compile(r"(?:…|\.\.|[,;:(–-])[\s\"'”“]*$")
_DATE = regex.compile(
    r"(?i)^(?:effective (?:from|as of) |as of |from |since |on )?(?:\p{N}{4}[-/.]\p{N}{1,2}(?:[-/.]\p{N}{1,2})?(?:t[\p{N}:.z]+)?|\p{N}{1,2}[-/.]\p{N}{4}|\p{N}{1,2}[-/.]\p{N}{1,2}[-/.]\p{N}{4}"
    r"|(?:\p{N}{1,2}(?:st|nd|rd|th)? )?(?:" + "|".join(MONTHS_EN) + r"|" + "|".join(m[:3] for m in MONTHS_EN) + r")\.?,? (?:\p{N}{1,2}(?:st|nd|rd|th)?,? )?\p{N}{4})\.?$"
)
_CUT_DATE = regex.compile(r"^(?:\p{N}{1,3}|\p{N}{4}[-/]|\p{N}{4}-0|\p{N}{2}/\p{N}{0,3})$")
_FLAG = regex.compile(r"(?i)^(?:0|1|[01]\.0|true|false|yes|no|y|n|t|f)\.?$")
_LEAD_IN = regex.compile(r"(?i)^(?:\*{0,2}(?:summary|answer|note|question|response|result)\*{0,2}:?|sure[.,!]?|certainly[.,!]?|here (?:is|it is)[.:]?)$")


def is_empty(value: str | None) -> bool:
    if value is None:
        return True
    v = _WRAP.sub("", value).lower()
    return not _VISIBLE.search(v) or v.strip("[](){}<>.,;: ") in PLACEHOLDERS


def clauses(value: str) -> list[str]:
    """Clauses with a letter or digit, without wrapping marks."""
    return [c for c in (_WRAP.sub("", p) for p in _CLAUSE.split(_WRAP.sub("", value))) if _VISIBLE.search(c)]


def words(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def frame(clause: str) -> str:
    """How a clause begins and ends: two words each, figures by their number of digits."""
    w = [regex.sub(r"\p{N}", "0", x) for x in words(clause)]
    return " ".join(w[:2]) + " … " + " ".join(w[-2:])


def _grams(w: list[str]) -> set:
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} | {tuple(w[i : i + 2]) for i in range(len(w) - 1)}


def _copied(w: list[str], source: set) -> float:
    """Share of the clause's runs of three words (two in a short one) that the source has as well."""
    n = 3 if len(w) >= 4 else 2
    runs = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    return sum(r in source for r in runs) / len(runs) if runs else 0.0


class Wording:
    """How much a clause is worded like a refusal: a logistic regression over its words and word pairs."""

    def __init__(self, refusals: list[str], others: list[str], steps: int = 300, reg: float = 1e-5):
        seen = Counter(refusals), Counter(others)
        y = np.r_[np.ones(len(seen[0])), np.zeros(len(seen[1]))]
        weight = np.sqrt([*seen[0].values(), *seen[1].values()], dtype=float)
        for k in (0, 1):
            weight[y == k] /= max(2 * weight[y == k].sum(), 1e-9)  # both sides alike
        grams = [self.grams(c) for c in (*seen[0], *seen[1])]
        self.index: dict[str, int] = {}
        col = np.array([self.index.setdefault(g, len(self.index)) for q in grams for g in q], np.int64)
        row = np.repeat(np.arange(len(grams)), [len(q) for q in grams])
        val = 1 / np.sqrt(np.bincount(row, minlength=len(grams)))[row]
        self.w, self.b = np.zeros(len(self.index)), 0.0
        m, v = np.zeros(len(self.index)), np.zeros(len(self.index))
        for it in range(1, steps + 1):
            score = np.bincount(row, self.w[col] * val, len(grams)) + self.b
            miss = (y - 1 / (1 + np.exp(-score))) * weight
            g = np.bincount(col, miss[row] * val, len(self.w)) - reg * self.w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            self.w += 0.1 * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-7)
            self.b += 0.5 * miss.sum()

    @staticmethod
    def grams(clause: str) -> list[str]:
        w = [x for x in words(clause) if not x[0].isdigit()]
        return list(dict.fromkeys(w + [f"{a} {b}" for a, b in zip(["^", *w], w)]))

    def of(self, clause: str) -> float:
        """Log odds; a clause without any known word has those of the offset alone."""
        q = self.grams(clause)
        return sum(self.w[self.index[g]] for g in q if g in self.index) / max(1, len(q)) ** 0.5 + self.b


def valueless(parts: list[str], variable: str, question: set, given: set) -> list[str]:
    """Whole sentences of an answer to a question for a date or a flag that hold no value or figure and repeat nothing."""
    if variable == "summary" or any(_DATE.match(c) or _FLAG.match(c) for c in parts):
        return []
    out = []
    for c in parts:
        w = words(c)
        if len(w) > 3 and _DONE.search(c) and not any(t[0].isdigit() for t in w) and max(_copied(w, question), _copied(w, given)) < 0.3:
            out.append(c)
    return out


N_FEATURES = 22


def featurise(parts: list[str], variable: str, question: set, given: set, frame_known: bool, wording: Wording) -> np.ndarray:
    """Features of every clause of one response."""
    x = np.zeros((len(parts), N_FEATURES))
    for i, c in enumerate(parts):
        w = words(c)
        n = max(1, len(w))
        last, first = i == len(parts) - 1, i == 0
        done = bool(_DONE.search(c)) or not last
        frame_known = frame_known and not _BROKEN_OFF.search(c)
        value = bool(_DATE.match(c)) or bool(_FLAG.match(c))
        english = sum(t in ENGLISH for t in w) / n
        foreign = sum(t in FOREIGN_WORDS or t.startswith(ELISIONS) for t in w) / n
        month = any(t in MONTHS_FOREIGN for t in w)
        copied_q, copied_g = _copied(w, question), _copied(w, given)
        if len(w) <= 3 and w and w[0] in ALONE_FOREIGN:
            foreign = 1.0
        shaped = variable != "summary"
        declines = wording.of(c)
        x[i] = [
            1.0,
            min(1.0, english * 2.5),
            min(1.0, foreign * 2.5),
            float(foreign > english and foreign >= 0.15),
            float(bool(regex.search(r"[äöüßéèêàâçñíóúáìòùãõ]", c.lower()))),
            float(declines > 0),
            copied_q,
            float(copied_q > 0.55),
            float(copied_g > 0.6 and len(w) > 3),
            float(value),
            float(not done and not value and not frame_known),
            float(not done and not value and w and w[-1] in ENGLISH),
            float(not done and frame_known and not value),
            float(shaped and bool(_CUT_DATE.match(c)) and not value) if variable == "legally_effective" else float(shaped and not value and len(w) == 1 and any(v.startswith(w[0]) and v != w[0] for v in ("true", "false", "yes"))),
            float(month and not value),
            float((shaped or len(w) == 1) and len(w) <= 3 and w and w[0] in ALONE_FOREIGN),
            float(bool(_LEAD_IN.match(c))),
            float(shaped),
            float(last and not first),
            float(first and last),
            float(copied_q == 1.0 and len(w) > 2),
            min(1.0, max(-1.0, declines / 4)),
        ]
    return x


class Field:
    """Linear-chain conditional random field over TAGS: node weights (features x tags), transitions, start weights."""

    def __init__(self, n_features: int = N_FEATURES):
        k = len(TAGS)
        self.node, self.step, self.start = np.zeros((n_features, k)), np.zeros((k, k)), np.zeros(k)

    def fit(self, xs: list[np.ndarray], ys: list[np.ndarray], steps: int = 250, rate: float = 0.15, reg: float = 3e-4) -> None:
        n, width, k = len(xs), max(map(len, xs)), len(TAGS)
        x = np.zeros((n, width, xs[0].shape[1]))
        y = np.zeros((n, width, k))
        mask = np.zeros((n, width))
        for i, (a, b) in enumerate(zip(xs, ys)):
            x[i, : len(a)], mask[i, : len(a)] = a, 1
            y[i, np.arange(len(b)), b] = 1
        pair = np.einsum("nta,ntb->ab", y[:, :-1], y[:, 1:])
        params = [self.node, self.step, self.start]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for it in range(1, steps + 1):
            s = x @ self.node
            s[:, 0] += self.start
            fwd = np.zeros((n, width, k))
            fwd[:, 0] = s[:, 0]
            for t in range(1, width):
                z = _lse(fwd[:, t - 1, :, None] + self.step[None], 1) + s[:, t]
                fwd[:, t] = np.where(mask[:, t, None] > 0, z, fwd[:, t - 1])
            total = _lse(fwd[:, -1], 1)
            bwd = np.zeros((n, width, k))
            for t in range(width - 2, -1, -1):
                z = _lse(self.step[None] + (s[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
                bwd[:, t] = np.where(mask[:, t + 1, None] > 0, z, 0.0)
            prob = np.exp(fwd + bwd - total[:, None, None]) * mask[:, :, None]
            both = np.zeros((k, k))
            for t in range(1, width):
                z = np.exp(fwd[:, t - 1, :, None] + self.step[None] + (s[:, t] + bwd[:, t])[:, None, :] - total[:, None, None])
                both += (z * mask[:, t, None, None]).sum(axis=0)
            grads = [np.einsum("ntf,ntk->fk", x, (y * mask[:, :, None]) - prob) / n, (pair - both) / n, (y[:, 0] - prob[:, 0]).sum(axis=0) / n]
            for p, g, a, b in zip(params, grads, m1, m2):
                g = g - reg * p
                a[...] = 0.9 * a + 0.1 * g
                b[...] = 0.99 * b + 0.01 * g * g
                p += rate * (a / (1 - 0.9**it)) / (np.sqrt(b / (1 - 0.99**it)) + 1e-8)

    def tag(self, x: np.ndarray) -> list[int]:
        s = x @ self.node
        best, back = s[0] + self.start, []
        for t in range(1, len(s)):
            z = best[:, None] + self.step
            back.append(z.argmax(axis=0))
            best = z.max(axis=0) + s[t]
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def judge(parts: list[str], tags: list[int], x: np.ndarray) -> str | None:
    """The pair's defect from the words that each tag covers; lead-ins cover none, and what repeats nothing is no echo."""
    cover = dict.fromkeys(TAGS, 0)
    for c, t, f in zip(parts, tags, x):
        t = 0 if TAGS[t] == "echo" and not (f[6] or f[8]) else t
        cover[TAGS[t]] += 0 if _LEAD_IN.match(c) and len(parts) > 1 else max(1, len(words(c)))
    total = sum(cover.values()) or 1
    if cover["refusal"] / total >= 0.5:
        return "refusal"
    if cover["echo"] / total >= 0.5:
        return "echo"
    if cover["foreign"] / total >= 0.5:
        return "language"
    return "truncated" if TAGS[tags[-1]] == "unfinished" else None


# made-up refusals for training: who, what, and how it goes on
_WHO = ["I cannot", "I can't", "I'm sorry, but I can't", "I am not able to", "As an AI model, I am not able to", "As a language model, I cannot", "I must decline to", "Unfortunately, I am unable to", "I'm afraid I cannot", "We are unable to", "My guidelines prevent me from", "It would not be appropriate for me to", "This request conflicts with what I am allowed to do and I will not"]
_WHAT = ["answer this.", "help with this request.", "provide an answer.", "process documents of this kind.", "give legal advice.", "assess the text.", "comment on this", "complete the request."]
_REFUSED = [
    f"{a} {b}"
    for who, what in [
        (["Je ne peux pas", "Je suis désolé, mais je ne peux pas"], ["répondre à cette question.", "vous aider.", "traiter cette demande."]),
        (["Leider kann ich", "Ich kann leider", "Es tut mir leid, aber ich kann"], ["dabei nicht helfen.", "diese Frage nicht beantworten.", "die Anfrage nicht ausführen."]),
        (["No puedo", "Lo siento, pero no puedo"], ["responder a esta solicitud.", "ayudar.", "tratar esta petición."]),
        (["Non posso", "Mi dispiace, ma non posso"], ["rispondere a questa richiesta.", "aiutare.", "trattare il testo."]),
        (["Ik kan helaas", "Helaas kan ik"], ["deze vraag niet beantwoorden.", "u niet helpen.", "dit verzoek niet uitvoeren."]),
        (["Não posso", "Desculpe, mas não posso"], ["responder a este pedido.", "ajudar.", "tratar este texto."]),
    ]
    for a in who
    for b in what
]
_AFTER = ["", "", "Please ask a lawyer.", "The text is too long.", "Thank you.", "Please try again later."]
_OTHER = [
    "La loi modifie le montant des prestations pour les familles.", "Ce texte règle la durée des droits.", "Le décret fixe les taux pour les assurés.",
    "La ley cambia la cuantía de las prestaciones para las familias.", "El texto regula la duración de los derechos.", "La norma fija los tipos para los asegurados.",
    "La legge modifica l'importo delle prestazioni per le famiglie.", "Il testo regola la durata dei diritti.", "Il decreto stabilisce le aliquote per gli assicurati.",
    "De wet wijzigt de hoogte van de uitkering voor gezinnen.", "De tekst regelt de duur van het recht.", "Het besluit bepaalt de tarieven voor verzekerden.",
    "A lei altera o valor das prestações para as famílias.", "O texto regula a duração dos direitos.", "Das Gesetz ändert die Höhe der Leistungen für Familien.", "Die Verordnung regelt die Dauer des Anspruchs.",
]


def training_set(rows: list[tuple[str, str, str, str]], frames: set[str], declined: list[str] = (), seed: int = 5) -> tuple[list, list, Wording]:
    """Features and tags of sound and damaged responses made from rows ``(variable, question, given, value)``, and the wording.

    ``declined`` are sentences of the corpus that decline to answer.
    """
    rng = random.Random(seed)
    xs, ys = [], []
    declined = sorted(declined)
    made = [f"{a} {b}" for a in _WHO for b in _WHAT] + _REFUSED
    others = [c for v, q, g, x in rows for c in (clauses(x) if v == "summary" else clauses(q)[:2])] + [c for _, _, g, _ in rows for c in clauses(g)[:6]]
    wording = Wording(declined + made, others)

    def add(parts, variable, question, given, tags):
        if not parts or len(parts) > LONGEST:
            return
        known = frame(parts[-1]) in frames
        xs.append(featurise(parts, variable, _grams(words(question)), _grams(words(given)), known, wording))
        ys.append(np.array([TAGS.index(t) for t in tags]))

    texts = [g for _, _, g, _ in rows]
    prose = [c for v, _, _, x in rows if v == "summary" for c in clauses(x)[:1] if sum(t in ENGLISH for t in words(c)) > 1]
    for variable, question, given, value in rows:
        asks = [p for p in regex.split(r"(?<=[.?!])\s+", question) if p.strip()]
        kind = rng.random()
        if kind < 0.12:
            text = rng.choice(asks)
            w = text.split()
            text = rng.choice([text, text.lower(), text.upper(), "Question: " + text, " ".join(w[: max(3, len(w) * 2 // 3)])])
            parts = clauses(text)
            add(parts, variable, question, given, ["answer" if _LEAD_IN.match(p) else "echo" for p in parts])
        elif kind < 0.2:
            lines = [regex.sub(r"^[\p{L} ]{2,12}: *", "", x).rstrip(".") for x in given.split("\n") if x.strip()]
            parts = clauses(". ".join(lines[: rng.choice([1, 2, 2, 3])]) + rng.choice([".", ""]))
            add(parts, variable, question, given, ["echo"] * len(parts))
        elif kind < 0.32:
            style = rng.random()
            text = rng.choice(_REFUSED) if style < 0.2 else rng.choice(declined) if style < 0.6 and declined else f"{rng.choice(_WHO)} {rng.choice(_WHAT)}"
            text = rng.choice(["", "", "Note: "]) + text
            parts = clauses((text.lower() if rng.random() < 0.2 else text) + " " + rng.choice(_AFTER))
            add(parts, variable, question, given, ["answer" if _LEAD_IN.match(p) and len(p) < 9 else "refusal" for p in parts])
        elif kind < 0.42:
            text = rng.choice(_OTHER) if rng.random() < 0.7 else (clauses(rng.choice(texts)) or [""])[-1]
            if variable == "legally_effective":
                text = rng.choice(["ab ", "", "dès ", "dal 1 ", "1. "]) + rng.choice(sorted(MONTHS_FOREIGN)) + f" {rng.randint(1990, 2024)}"
            elif variable == "crisis_ref" and rng.random() < 0.8:
                text = rng.choice(sorted(ALONE_FOREIGN))
            parts = clauses(text)
            if _copied(words(text), _grams(words(given))) < 0.3:
                add(parts, variable, question, given, ["foreign"] * len(parts))
        else:
            parts = clauses(value)
            sound = parts and not is_empty(value) and all(wording.of(p) < 0 for p in parts) and sum(t in FOREIGN_WORDS for t in words(value)) <= 0.2 * len(words(value))
            sound = sound and all(_copied(words(p), _grams(words(question))) < 0.4 and _copied(words(p), _grams(words(given))) < 0.4 for p in parts)
            if not sound:
                continue
            if variable != "summary":
                if prose and rng.random() < 0.12:
                    w = rng.choice(prose).split()
                    cut = rng.choice(["", "Yes, ", "No, "]) + " ".join(w[: rng.randint(2, 4)])
                    add([cut[: -rng.randint(0, 2) or None].rstrip(".,")], variable, question, given, ["unfinished"])
                elif _DATE.match(parts[-1]) or _FLAG.match(parts[-1]):
                    if rng.random() < 0.3 and len(parts[-1]) > 3:
                        cut = parts[-1][: rng.choice([2, 3])]
                        add([cut], variable, question, given, ["unfinished"])
                    else:
                        add(parts, variable, question, given, ["answer"] * len(parts))
            elif _DONE.search(parts[-1]):
                style = rng.random()
                if style < 0.35:
                    at = rng.randint(max(4, len(parts[-1]) // 4), max(5, len(parts[-1]) - 2))
                    cut = parts[-1][:at].rstrip()
                    if cut and frame(cut) not in frames:
                        add([*parts[:-1], cut], variable, question, given, ["answer"] * (len(parts) - 1) + ["unfinished"])
                elif style < 0.55:
                    bare = parts[-1].rstrip(".!? ")
                    if frame(bare) in frames:
                        add([*parts[:-1], bare], variable, question, given, ["answer"] * len(parts))
                else:
                    more = [rng.choice(prose) for _ in range(rng.randint(2, 8))] if prose and rng.random() < 0.25 else []
                    add([*more, *parts], variable, question, given, ["answer"] * (len(more) + len(parts)))
    return xs, ys, wording


def pair_rows(df: DataFrame, key: str, prompt: str, prompt_key: str, answers: str, error: str, asked: dict[str, list[str]], given_mark: str) -> DataFrame:
    """``(key, variable, question, given, value)``: one row per asked variable of every entry without error.

    ``asked`` maps a part of the prompt key to the variables it asks for; the first match counts. Under a key that has none of
    the parts, or a null one, what was asked is not known: the variables that the map holds are taken. A null map gives null
    values.
    """
    # spread before the variables are taken apart, so that a prompt is moved once
    base = spread(df.where(F.col(error).isNull() & F.col(key).isNotNull()).select(*dict.fromkeys([key, prompt, prompt_key, answers])))
    every = F.array(*[F.lit(n) for n in dict.fromkeys(n for names in asked.values() for n in names)])
    what = F.array_intersect(every, F.coalesce(F.map_keys(answers), F.array().cast("array<string>")))
    for part, names in reversed(list(asked.items())):
        what = F.when(F.col(prompt_key).contains(part), F.array(*[F.lit(n) for n in names])).otherwise(what)
    at = F.instr(F.col(prompt), given_mark)
    p = F.coalesce(F.col(prompt), F.lit(""))
    question = F.when(at > 0, F.substring_index(p, given_mark, 1)).otherwise(p)
    given = F.when(at > 0, F.expr(f"substring(`{prompt}`, instr(`{prompt}`, '{given_mark}'))")).otherwise(F.lit(""))
    return base.select(F.col(key).alias("k"), question.alias("question"), given.alias("given"), F.col(answers).alias("__m"), F.explode(what).alias("variable")).select(
        "k", "variable", "question", "given", F.element_at("__m", F.col("variable"))["value"].alias("value")
    )


def pair_defects(pairs: DataFrame, key: str) -> DataFrame:
    """``(key, variable, defect)``: one row per defective answer of ``pairs`` (``k, variable, question, given, value``).

    Null, blank and placeholder values are ``empty``. Empty tables give an empty result; repeated keys are judged row by
    row; very long answers are read whole.
    """
    spark = pairs.sparkSession
    kind = pairs.schema["k"].dataType.simpleString()

    def collect_frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [frame(c) for v in b["value"] if v for c in clauses(v) if _DONE.search(c)]
            u, n = np.unique(np.array(out, object).astype(str), return_counts=True) if out else ([], [])
            if out:
                yield pd.DataFrame({"frame": list(u), "n": np.array(n, np.int64)})

    texts = pairs.where("variable = 'summary'").select("value")
    frames = cut_lineage(texts.mapInPandas(collect_frames, "frame string, n bigint").groupBy("frame").agg(F.sum("n").alias("n")))

    sample = pairs.where("value IS NOT NULL").withColumn("h", F.xxhash64("k", "variable")).orderBy("h", "k").limit(TRAIN_PAIRS).select("variable", "question", "given", "value").collect()
    rows = [(r["variable"], r["question"], r["given"], r["value"]) for r in sample]
    wanted = {frame(c) for _, _, _, v in rows for c in clauses(v)}
    if rows:
        rng = random.Random(11)
        cuts = set()
        for var, _, _, v in rows:
            if var == "summary" and (cs := clauses(v)):
                cuts |= {frame(cs[-1].rstrip(".!? ")), frame(cs[-1][: rng.randint(1, len(cs[-1]))])}
        wanted |= cuts
    # sentences that decline, of all answers to questions for a date or a flag (those of up to three words hold a value)
    def find_declined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [c for v, q, g, x in zip(b["variable"], b["question"], b["given"], b["value"]) for c in valueless(clauses(x), v, _grams(words(q)), _grams(words(g)))]
            if out:
                yield pd.DataFrame({"c": out})

    long = pairs.where((F.col("variable") != "summary") & (F.size(F.split("value", r"\s+")) > 3))
    declined = [r["c"] for r in long.mapInPandas(find_declined, "c string").orderBy(F.xxhash64("c"), "c").limit(TRAIN_DECLINED).collect()]
    names = spark.createDataFrame([(f,) for f in wanted] or [("",)], "frame string")
    # of a frame that a training response has itself, another one is needed
    common = {r[0] for r in frames.where("n >= 2").join(F.broadcast(names), "frame", "left_semi").select("frame").collect()}
    model = Field()
    xs, ys, wording = training_set(rows, common, declined)
    if xs:
        model.fit(xs, ys)

    # only answers without a final mark need the table of frames
    @F.pandas_udf("string")
    def open_frame(v: pd.Series) -> pd.Series:
        def one(x):
            cs = clauses(x) if x else []
            return frame(cs[-1]) if cs and not _DONE.search(cs[-1]) else None

        return v.map(one, na_action="ignore")

    n_frames = frames.count()
    known = frames.select(F.col("frame").alias("__frame"), F.lit(True).alias("known"))
    # answers with a final mark have no frame and must not meet in one task
    with_frame = pairs.withColumn("__frame", F.coalesce(open_frame("value"), F.concat(F.lit("\x00"), F.xxhash64("k").cast("string"))))
    joined = with_frame.join(F.broadcast(known) if n_frames <= BROADCAST_FRAMES else known, "__frame", "left")
    shared = spark.sparkContext.broadcast((model, wording))

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, wording = shared.value
        grams: dict[str, set] = {}
        text, of_text = None, set()
        short: dict[tuple, str | None] = {}
        for b in batches:
            keys, variables, defects = [], [], []
            for k, var, q, g, v, kn in zip(b["k"], b["variable"], b["question"], b["given"], b["value"], b["known"]):
                # up to three words the given text has no say (see featurise), so such values are judged once
                same = (var, q, v) if v is not None and len(v) < 40 and v.count(" ") < 3 else None
                if same in short:
                    d = short[same]
                elif is_empty(v):
                    d = "empty"
                else:
                    parts = clauses(v)
                    if q not in grams:
                        if len(grams) > 2000:
                            grams.clear()
                        grams[q] = _grams(words(q))
                    # the variables of an entry stand one after the other and share its given text
                    if g != text:
                        text, of_text = g, _grams(words(g))
                    x = featurise(parts, var, grams[q], of_text, kn is True or kn == True, wording)  # noqa: E712
                    d = judge(parts, m.tag(x), x)
                    if same is not None and len(words(v)) <= 3 and kn is None:
                        if len(short) > 100_000:
                            short.clear()
                        short[same] = d
                if d:
                    keys.append(k)
                    variables.append(var)
                    defects.append(d)
            if keys:
                yield pd.DataFrame({"k": keys, "variable": variables, "defect": defects})

    out = joined.select("k", "variable", "question", "given", "value", "known").mapInPandas(tag, f"k {kind}, variable string, defect string")
    return out.withColumnRenamed("k", key)
