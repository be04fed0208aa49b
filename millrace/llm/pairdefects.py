"""Broken prompt and response pairs: a multi-label linear classifier.

Pairs of a bounded, documented sample are taken as they are (negatives) and are made
defective: cut, replaced by a copy of the question, answered in another language by swapping,
replaced by a refusal with or without reasoning before it, or by a stand-in for no answer. Bare
answers and closings behind other text are made as further negatives. One logistic model per
defect reads hashed n-grams and pair features: how much of the answer stands in the question
and the reverse, the language of each by sentence (llm.language) and whether the question asks for a
language, markers of a result, and the closing of the answer. A first round on structure alone finds
the sample's own defective pairs and takes them out of the negatives; thresholds are calibrated on
held-out pairs. Every pair is scored; a pair gets the defect with the largest margin over its threshold.
The features of the sample are computed on the cluster; the driver only fits the weights.

Defined results for odd input: null answers and those that are nothing but blanks and markers are
'empty' by definition, whatever the question; a null or blank question can have no copied or foreign answer; very long texts are
read whole; repeated pairs are judged each; an empty table gives an empty result; only the
named columns are read.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import linear
from millrace.llm.ending import STAND_INS, clearly_cut, cut, ending_features, last_segment, nothing_left, think_state, without_markers
from millrace.llm.language import Languages
from millrace.operators import sampling

DEFECTS = ["empty", "truncated", "refusal", "copy", "other_language"]

# Names of the languages, in all of them.
_LANGUAGE_NAMES = {
    "en": r"english|anglais|inglés|ingles\b|englisch|английск|英文|英语",
    "fr": r"french|français|francais|francés|französisch|французск|法语|法文",
    "es": r"spanish|español|espanol|espagnol|spanisch|испанск|西班牙|castellano",
    "de": r"german\b|allemand|alemán|deutsch|немецк|德语|德文",
    "zh": r"chinese|chinois|chino\b|chinesisch|китайск|中文|汉语|漢語",
    "ru": r"russian|russe\b|ruso\b|russisch|русск|俄语|俄文",
}
_NAMES = {
    "en": r"english|anglais|inglés|ingles\b|englisch|английск|英文|英语",
    "fr": r"french|français|francais|francés|französisch|французск|法语|法文",
    "es": r"spanish|español|espanol|espagnol|spanisch|испанск|西班牙|castellano",
    "de": r"german\b|allemand|alemán|deutsch|немецк|德语|德文",
    "zh": r"chinese|chinois|chino\b|chinesisch|китайск|中文|汉语|漢語",
    "ru": r"russian|russe\b|ruso\b|russisch|русск|俄语|俄文",
}
_STOP: dict[str, tuple[str, ...]] = {}
_NAMES = {code: re.compile(p) for code, p in _LANGUAGE_NAMES.items()}
_TOKENS = re.compile(r"[぀-ヿ一-鿿]|[^\W_぀-ヿ一-鿿]+|[.!?。！？;；\n]")
_SPLITS = set(".!?。！？;；\n")
_CAPITALS = re.compile(r"(?<=[^.!?。\s:])\s([A-ZÀ-Þ][^\W\d_]+)")
_STAND_INS = sorted(STAND_INS)
_RESULT = re.compile(r"boxed|=\s*[\\\d(]|\b(?:answer|result|total|therefore|réponse|résultat|respuesta|resultado|antwort|ergebnis|lautet)\b|ответ|результат|答案|结果|等于")

# Ways to decline, for training; {} stands for nothing.
_REFUSALS = {
    "en": (
        ("", "I'm sorry, but ", "Sorry, ", "My apologies: ", "I apologize; ", "Unfortunately, ", "Regrettably, ", "As an AI language model, ", "As an automated assistant, ", "To be honest, ", "Let me be clear: ", "Thank you for asking, however ", "After some thought, "),
        ("I can't help with this request", "I cannot answer this question", "I'm unable to assist with that", "I am not able to work on this problem", "I won't be giving a solution", "I must decline to solve it", "I have to decline", "I will not provide an answer", "I would rather not answer", "no solution will be provided by me", "there will be no worked solution from my side", "I do not feel comfortable completing this task", "I choose not to do this", "my guidelines do not allow me to discuss this", "my instructions do not let me go into it", "this is outside of what I may discuss", "requests of this kind are not something I take on", "answering this would go against my rules", "this belongs to topics I keep away from", "I have to pass on this exercise", "it is better that somebody else takes this one", "I would rather leave this one alone", "I cannot in good conscience provide the steps", "I refuse to answer", "I could try, but I choose not to"),
        (".", ". Please ask a teacher instead.", " at this time.", ", and I hope you understand.", ". Is there something else you would like to talk about?", ". Thanks for your patience!", ". You could try a textbook on the topic.", ". The question remains open.", ""),
    ),
    "fr": (("", "Désolé, ", "Je regrette, mais ", "Malheureusement, "), ("je ne peux pas répondre à cette question", "je ne suis pas en mesure de vous aider", "je préfère ne pas traiter cet exercice", "je dois refuser cette demande", "je ne fournirai pas de solution", "ce sujet dépasse ce que je peux aborder", "mes consignes ne me permettent pas de donner une solution ici"), (".", ", merci de votre compréhension.", " ; adressez-vous à un professeur.", "")),
    "es": (("", "Lo siento, ", "Lamentablemente, ", "Disculpa, "), ("no puedo responder a esta pregunta", "no me es posible contestar esta pregunta", "no puedo ayudar con esta solicitud", "prefiero no resolver este ejercicio", "debo rechazar esta petición", "no voy a dar una solución", "este tema queda fuera de lo que puedo tratar", "mis normas no me dejan dar aquí una solución"), (".", ", gracias por su comprensión.", "; consulte a un especialista.", "")),
    "de": (("", "Es tut mir leid, ", "Leider ", "Entschuldigung, "), ("ich kann diese Frage nicht beantworten", "kann ich diese Frage nicht beantworten", "ich kann dabei nicht helfen", "ich möchte diese Aufgabe nicht bearbeiten", "ich muss diese Anfrage ablehnen", "ich werde keine Lösung angeben", "dieses Thema liegt außerhalb dessen, was ich behandeln darf", "meine Vorgaben erlauben mir hier keine Lösung"), (".", ", danke für Ihr Verständnis.", "; bitte fragen Sie eine Lehrkraft.", "")),
    "ru": (("", "Извините, ", "К сожалению, ", "Простите, "), ("я не могу ответить на этот вопрос", "я не могу помочь с этой просьбой", "я не буду решать эту задачу", "я вынужден отказаться", "я предпочёл бы не решать эту задачу", "эта тема выходит за рамки того, что я могу обсуждать", "мои правила не позволяют мне дать здесь решение"), (".", ", спасибо за понимание.", "; обратитесь к преподавателю.", "")),
    "zh": (("", "抱歉,", "对不起,", "很遗憾,"), ("我无法回答这个问题", "我不能帮助解答这个请求", "我不方便解这道题", "这类题目我不处理", "我拒绝回答", "这超出了我可以讨论的范围", "我的规定不允许我在这里给出解答"), ("。", ",谢谢理解。", ",请咨询老师。", "")),
}
_ABOUT = {
    "en": "The question about {} and {} remains open.", "fr": "La question sur {} et {} reste ouverte.", "es": "La pregunta sobre {} y {} queda abierta.",
    "de": "Die Frage zu {} und {} bleibt offen.", "ru": "Вопрос о {} и {} остаётся открытым.", "zh": "关于{}和{}的问题留待以后。",
}
_LANGUAGES = {"en": ("English", "inglés", "anglais", "Englisch"), "fr": ("French", "français"), "es": ("Spanish", "español"), "de": ("German", "Deutsch"), "ru": ("Russian", "русский язык"), "zh": ("Chinese", "中文")}
_WISHES = ("Answer in {}.", "Please answer in {}.", "Reply in {}.", "Your answer should be in {}.", "Write the solution in {}.", "Use {} for the whole answer.", "({}, please)", "The reply must be written in {}.")
_INTROS = ("", "", "", "Restating the task: ", "We are told: ", "The problem says: ", "You asked: ", "Question: ", "The question is as follows:\n", "Problem:\n", "> ", "* ", "- ", "Here is the problem again: ")


_SIGNS = " \t\r\n\"'`*<>[](){}_.,:;!?-–—…"


def _language(counts: dict[str, float]) -> str:
    return max(counts, key=counts.get) if counts else ""


def _step(x: float, n: int = 10) -> int:
    return int(min(max(x, 0.0), 1.0) * n + 1e-9)


def _words(text: str) -> list[str]:
    return [w for w in _TOKENS.findall(text.lower()) if w not in _SPLITS]


def all_features(pairs: list[tuple[str | None, str]], languages: Languages) -> list[np.ndarray]:
    """Feature indices of pairs whose answers are more than blanks and markers."""
    plain = [without_markers(a) for _, a in pairs]
    asked_in, answered_in = languages.read_all([q or "" for q, _ in pairs]), languages.read_all(plain)
    return [np.concatenate(features(q, a, *rest)) for (q, a), *rest in zip(pairs, plain, asked_in, answered_in)]


def features(question: str | None, answer: str, plain: str, asked_in: dict[str, float], language: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """(structure, words) of a pair; plain is the answer without markers, the rest are words by language."""
    out = ending_features(answer)
    body = plain.rsplit("</think>", 1)[-1] if "</think>" in plain else plain.replace("<think>", " ")
    asked, words = _words(question) if question else [], _words(plain)
    plain_words = words if body is plain else _words(body)
    low = body.lower()
    # result and size
    result, digits = bool(_RESULT.search(low)), sum(w[0].isdigit() for w in plain_words)
    size = len(plain_words)
    out += [f"b:result={result}", f"b:digits={min(digits, 4)}", f"b:size={min(size, 80).bit_length()}", f"b:kind={result},{min(digits, 2)},{min(size, 80).bit_length()}"]
    # what little there is
    if size <= 6 and len(body) < 200:
        bare = low.strip(_SIGNS)
        out += [f"e:all={bare or low.strip()}", f"e:kind={'sign' if not bare else 'digit' if digits else 'word'},{min(size, 4)}"]
    # n-grams of the body; names become one sign
    names = {m.lower() for m in _CAPITALS.findall(body)}
    grams = ["0" if w[0].isdigit() else "A" if w in names else w for w in plain_words]
    lexical = [f"n:{g}" for g in grams]
    lexical += [f"n:{x} {y}" for x, y in zip(grams, grams[1:])]
    if min(size, 127).bit_length() <= 5:
        lexical += [f"n:{x} {y} {z}" for x, y, z in zip(grams, grams[1:], grams[2:])]
        lexical += [f"s:{result},{g}" for g in grams]
    # copy
    cover = 0.0
    last = plain.rstrip()[-1:]
    if asked and words:
        have, want = Counter(words), Counter(asked)
        shared = sum(min(n, have[w]) for w, n in want.items() if w in have)
        common = sum(n for w, n in have.items() if w in want)
        inside, extra, cover = common / len(words), len(words) - common, shared / len(asked)
        out += [f"c:inside={_step(inside, 20)}", f"c:cover={_step(cover)}", f"c:both={_step(inside)},{_step(cover, 5)}", f"c:extra={min(extra, 16).bit_length()},{_step(cover, 5)}"]
        out.append(f"c:end={cover > 0.95},{inside > 0.9},{think_state(answer)},{'mark' if last and last in '.!?。！？' else 'none'}")
        out.append(f"c:all={inside > 0.85},{cover > 0.85},{min(len(words), 9) > 8},{extra <= 6}")
    told = not digits and not result and bool(plain_words)
    last = body.rstrip()[-1:]
    out.append(f"b:told={told},{bool(last) and last in '.!?。！？'},{bool(asked) and cover < 0.5}")
    # language
    to, of = _language(asked_in), _language(language)
    if to and of:
        total = sum(language.values())
        mass = language[of] / total
        requested = of in _NAMES and bool(_NAMES[of].search(question.lower()))
        rest = language.get(to, 0.0) / total
        out += [f"l:differs={to != of}", f"l:{to != of},{requested},{_step(mass, 4)}", f"l:own={_step(rest, 8)},{requested}"]
        out.append(f"l:foreign={to != of and not requested and rest < 0.5 and language[of] >= 5}")
    else:
        out.append(f"l:none={bool(to)},{bool(of)}")
    return linear.hashed(out), linear.hashed(lexical, upper=True)


def refusal(language: str, rng: random.Random, question: str | None = None) -> str:
    """A declining answer, at times with a second sentence or a word about the question."""
    known = _REFUSALS.get(language) or _REFUSALS["en"]
    start, say, end = (rng.choice(x) for x in known)
    text = start + (say if start else say[0].upper() + say[1:]) + end
    if rng.random() < 0.25:
        again = rng.choice(known[1])
        text += " " + again[0].upper() + again[1:] + ("。" if language == "zh" else ".")
    if rng.random() < 0.25:
        about = re.findall(r"[^\W\d_]{4,}", question or "") or ["this"]
        text += f" {_ABOUT.get(language, _ABOUT['en']).format(rng.choice(about), rng.choice(about))}"
    return text


def copied(question: str, rng: random.Random) -> str:
    text = rng.choice(_INTROS) + question
    draw = rng.random()
    if draw < 0.12:
        text = text.lower()
    elif draw < 0.18:
        text = text.upper()
    elif draw < 0.30:
        text = rng.choice(("“{}”", '"{}"', "**{}**", "({})", "```\n{}\n```")).format(text)
    elif draw < 0.42:
        text = re.sub(" ", lambda m: rng.choice((" ", " ", "  ", "\n", "\t", " ")), text)
    elif draw < 0.5:
        text = re.sub(r"[.,;:!?]", "", text)
    elif draw < 0.62:
        text = text + rng.choice(("\n\n", " ", "\n")) + question
    if rng.random() < 0.15:
        text += rng.choice(("?", " ?", "...", "!", "??", " "))
    if rng.random() < 0.2:
        text = "<think>\n</think>\n\n" + text
    return text


_MARKS = ("", "", "", "<|im_end|>")


def stand_in(rng: random.Random) -> str:
    """A stand-in for no answer in one of its dresses."""
    text = rng.choice(_STAND_INS)
    text = rng.choice((text, text, text.upper(), text.capitalize()))
    if rng.random() < 0.3:
        text = rng.choice(("“{}”", '"{}"', "'{}'", "**{}**", "[{}]", "({})", "<{}>", "`{}`")).format(text)
    text += rng.choice(("", "", "", ".", "\n", " "))
    return rng.choice(("", "", "", "<think>\n</think>\n\n")) + text + rng.choice(_MARKS)


def bare(answer: str, rng: random.Random) -> str | None:
    """The closing of an answer alone: its last sentence, or the last value in it."""
    closing = last_segment(without_markers(answer).rstrip())
    values = re.findall(r"-?\d+(?:[.,/]\d+)*|[^\W\d_]{2,}", closing)
    if not values or think_state(answer) == "open":
        return None
    draw = rng.random()
    if draw < 0.4:
        return closing
    if draw < 0.75:
        return re.sub(r"[.。]$", "", closing)
    return rng.choice(("", "", "= ", "**")) + values[-1] + rng.choice(("", "", "."))


class Sample:
    """The pairs that a model learns from, with what making defects of one needs of the others."""

    def __init__(self, pairs: list[tuple[str | None, str]], seed: int):
        self.pairs, self.seed = pairs, seed
        self.languages = Languages.learn([x for q, a in pairs for x in (q, a) if x])
        self.spoken: list[str] = []
        self.by: dict[str, list[int]] = {}
        self.asked = [_language(x) for x in self.languages.read_all([q or "" for q, _ in pairs])]
        for k, language in enumerate(self.languages.read_all([without_markers(a) for _, a in pairs])):
            self.spoken.append(_language(language) if sum(language.values()) >= 8 else "")
            if self.spoken[-1]:
                self.by.setdefault(self.spoken[-1], []).append(k)

    def made(self, k: int) -> list[tuple[str | None, str, int]]:
        """(question, answer, defect or -1) made from pair k; the same wherever it runs."""
        rng = random.Random(f"{self.seed}:{k}")
        q, a = self.pairs[k]
        out: list[tuple[str | None, str, int]] = []
        for _ in range(2):
            if c := cut(a, rng):
                out.append((q, c, 1))
        if q and len(q) > 20 and rng.random() < 0.2:  # cut in or soon after a repeated question
            lead = rng.choice(_INTROS) + q
            at = rng.randrange(len(lead) // 2, len(lead) + 80)
            head = f"{lead}\n\n{a}"[:at].rstrip()
            if at < len(lead) - 3 or at > len(lead) + 3 and (clearly_cut(head) or head[-1:].isalnum()):
                out.append((q, head + rng.choice(("", "", "...")), 1))
        if rng.random() < 0.3:
            out.append((q, stand_in(rng), 0))
        if rng.random() < 0.5 and (closing := bare(a, rng)):  # a closing is none the worse for what precedes it
            other = without_markers(self.pairs[rng.randrange(len(self.pairs))][1])
            lead = re.match(r"[^.!?。！？\n]{10,}[.。]", other)
            out.append((q, closing if rng.random() < 0.4 or not lead else f"{lead.group()}\n\n{closing}", -1))
        asked = self.asked[k]
        tongues = [asked if asked in _REFUSALS else "en"] + ([rng.choice(list(_REFUSALS))] if rng.random() < 0.3 else [])
        for say in [refusal(x, rng, q) for x in tongues]:
            if rng.random() >= 0.4:
                out.append((q, say + rng.choice(_MARKS), 2))
                continue
            m = re.match(r"\s*<think>.*?</think>", a, re.S)
            thought = m.group() if m else "<think>\n" + (a[: a.find(".") + 1] or a) + "\n</think>"
            out.append((q, thought + "\n\n" + say + rng.choice(_MARKS), 2))
        if q and q.strip() and len(q) > 20:
            out.append((q, copied(q, rng) + rng.choice(_MARKS), 3))
            others = [x for x in sorted(self.by) if x != asked and not (x in _NAMES and _NAMES[x].search(q.lower()))]
            if asked and others:
                j = rng.choice(self.by[rng.choice(others)])
                out.append((q, self.pairs[j][1], 4))
                if self.spoken[j] in _LANGUAGES:
                    wish = rng.choice(_WISHES).format(rng.choice(_LANGUAGES[self.spoken[j]]))
                    out.append((f"{q} {wish}" if rng.random() < 0.8 else f"{wish} {q}", self.pairs[j][1], -1))  # asked for: no defect
        return out

    def examples(self, k: int) -> list[tuple[int, np.ndarray]]:
        """(defect, features) of pair k as it is (defect -2) and of all made from it."""
        all_of = [(*self.pairs[k], -2)] + [x for x in self.made(k) if not nothing_left(x[1])]
        return list(zip([d for *_, d in all_of], all_features([(q, a) for q, a, _ in all_of], self.languages)))


def fit(origin: np.ndarray, defect: np.ndarray, rows: linear.Rows, pairs: int) -> linear.Linear:
    """The model from all examples, after dropping the sample's own defective pairs from the negatives.

    Structure alone finds these in a first round, whatever their wording; words join in the
    second, and the last, longest round learns from what the second found.
    """
    natural = np.flatnonzero(defect == -2)
    at = np.empty(pairs, np.int64)
    at[origin[natural]] = natural  # row of each pair as it is
    keep, guessed, model = np.ones(pairs, bool), np.full(pairs, -1), linear.Linear.blank(DEFECTS, 1.0)
    for stage, epochs in enumerate((6, 6, 12)):
        own = defect == -2
        used = np.flatnonzero(np.where(own, keep[origin] | (guessed[origin] >= 0), (defect >= 0) | keep[origin]))
        label = np.where(own, guessed[origin], defect)[used]
        view = rows.lower() if stage == 0 else rows
        truth = np.zeros((len(used), len(DEFECTS)))
        truth[np.flatnonzero(label >= 0), label[label >= 0]] = 1
        held = origin[used] % 5 == 0
        part = ~held if (~held).any() else np.ones(len(used), bool)
        model = linear.train(DEFECTS, view.take(used[part]), truth[part], epochs, lower_only=(DEFECTS.index("truncated"),))
        if held.any():
            linear.calibrate(model, view.take(used[held]), truth[held], np.where(truth[held].sum(1) > 0, 0.2, 1.0))
        scores = model.scores(view.take(at))
        # cuts come in many degrees, so they must be plainer than the other defects to count as found; a bare closing is easily taken for one
        keep = (scores < [0.5, 0.8, 0.3, 0.3, 0.3]).all(1)
        guessed = np.where((scores > [0.97, 0.999, 0.9, 0.9, 0.9]).any(1), scores.argmax(1), -1)
        if not keep.any():
            break
    return model


class Model:
    """The fitted weights and the language model that the features need."""

    def __init__(self, linear_model: linear.Linear, languages: Languages):
        self.linear, self.languages = linear_model, languages


def train(spark: SparkSession, found: list[tuple[str | None, str | None]], seed: int = 5) -> Model:
    """The model of a bounded sample; its features are computed on the cluster."""
    pairs = [(q, a) for q, a in found if not nothing_left(a)]
    sample = Sample(pairs, seed)
    if not pairs:
        return Model(linear.Linear.blank(DEFECTS, 1.0), sample.languages)
    return Model(fit(*linear.gathered(spark, sample, len(pairs)), len(pairs)), sample.languages)


def decide(model: Model, questions: list[str | None], answers: list[str | None]) -> list[str | None]:
    """The defect of each pair, or None."""
    empty = [nothing_left(a) for a in answers]
    said = iter(all_features([(q, a) for q, a, e in zip(questions, answers, empty) if not e], model.languages))
    scores = model.linear.scores([np.zeros(0, np.int32) if e else next(said) for e in empty])
    logit = lambda p: np.log(p / (1 - p))
    margin = logit(np.clip(scores, 1e-9, 1 - 1e-9)) - logit(np.clip(model.linear.thresholds, 1e-9, 1 - 1e-9))
    best = margin.argmax(1) if empty else []
    return ["empty" if e else DEFECTS[b] if margin[i, b] > 0 else None for i, (e, b) in enumerate(zip(empty, best))]


def _decided(model_bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = decide(model_bc.value, batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["table_name", "row_id", "defect"])

    return run


def pair_rows(tables: list[tuple[str, DataFrame, str, str, str]]) -> DataFrame:
    """table_name, row_id, question, answer of several tables."""
    parts = [df.select(F.lit(n).alias("table_name"), F.col(i).cast("bigint").alias("row_id"), F.col(q).alias("question"), F.col(a).alias("answer")) for n, df, i, q, a in tables]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def defects(pairs: DataFrame, sample_rows: int = 4000) -> DataFrame:
    """table_name, row_id, defect of each defective pair; at most sample_rows pairs train the model."""
    sample = sampling.bounded(pairs, ["table_name", "row_id"], sample_rows).select("question", "answer").toArrow()
    model = train(pairs.sparkSession, list(zip(sample.column(0).to_pylist(), sample.column(1).to_pylist())))
    model_bc = pairs.sparkSession.sparkContext.broadcast(model)  # fixed size
    return pairs.mapInArrow(_decided(model_bc), "table_name string, row_id bigint, defect string").where("defect is not null")
