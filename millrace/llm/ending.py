"""Features of how a text ends, and artificial cuts of intact texts."""

from __future__ import annotations

import functools
import random
import re
import sys
import unicodedata

_MARKER = re.compile(r"<\|[A-Za-z_]+\|>|</?s>|\[/?(?:EOS|BOS|PAD|INST)\]")
_TAIL_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|\\[A-Za-z]+|[^\W\d_]+|[^\w\s]|_")
_SENTENCE = re.compile(r"(?:[.!?。！？]+[\"”’)\]]*\s+)|(?<=[。！？])|\n+")
_DOTS = re.compile(r"(?:\.{2,}|…)+\s*$")
_DIGITS = re.compile(r"\d+")
# What stands in for no answer.
STAND_INS = {"null", "none", "n/a", "na", "nan", "nil", "undefined", "empty", "no answer", "no output", "no response", "not available", "unknown", "tbd", "todo", "-", "--", "—", "...", "…", "?", "_", "[]", "{}", "()", '""', "''"}
_TERMINAL = ".!?。！？"


def without_markers(text: str) -> str:
    return _MARKER.sub("", text)


@functools.cache
def _invisible() -> re.Pattern:
    """Format and control characters (Cf, Cc)."""
    return re.compile("[" + "".join(re.escape(c) for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Cf", "Cc")) + "]")


def nothing_left(text: str | None) -> bool:
    """Null, or nothing but blanks, invisible characters, markers and empty reasoning."""
    return text is None or not _left(text)


def _left(text: str) -> str:
    if len(text) > 1 and text[0].isalnum() and text[-1].isalnum():
        return text
    return _invisible().sub(" ", re.sub(r"<think>\s*</think>|</?think>", " ", without_markers(text))).strip()


def says_nothing(text: str | None) -> bool:
    """Null, or nothing but blanks, markers, empty reasoning or a stand-in for no answer."""
    if text is None:
        return True
    left = _left(text)
    return not left or left.casefold().strip(" \"'`*<>[]()") in STAND_INS | {""} or left in STAND_INS


def think_state(text: str) -> str:
    opened, closed = text.count("<think>"), text.count("</think>")
    return "none" if not opened and not closed else "open" if text.rfind("<think>") > text.rfind("</think>") or opened > closed else "closed"


def open_formula(text: str) -> list[str]:
    """Kinds of delimiters that were opened and not closed."""
    out = []
    if text.count("{") > text.count("}"):
        out.append("{")
    if (text.count("$") - text.count("\\$")) % 2:
        out.append("$")
    if text.count("\\(") > text.count("\\)"):
        out.append("\\(")
    if text.count("\\[") > text.count("\\]"):
        out.append("\\[")
    if text.count("(") > text.count(")"):
        out.append("(")
    if text.count("“") > text.count("”"):
        out.append("“")
    if text.count("**") % 2:
        out.append("**")
    return out


def _shape(token: str) -> str:
    c = token[0]
    if c.isdigit():
        return "0"
    if c.isalpha() and c != c.lower():
        return "A" if len(token) > 1 else "V"
    return token


def last_segment(text: str) -> str:
    """The text after its last sentence end; the tail decides where it holds one."""
    size = len(text)
    for start in (max(0, size - 400), 0):
        end = -1
        for m in _SENTENCE.finditer(text, start):
            if m.end() < size:
                end = m.end()
        if end >= 0 or not start:
            return text[max(end, 0) :]
    return text


def ending_features(text: str) -> list[str]:
    """Feature names of the closing of a whole text (delimiters count over all of it)."""
    text = without_markers(text).rstrip()
    out = [f"t:think={think_state(text)}"]
    if not text:
        return [*out, "t:nothing"]
    opened = open_formula(text)
    out += [f"t:open={o}" for o in opened]
    out.append(f"t:opened={min(len(opened), 2)}")
    dots = bool(_DOTS.search(text))
    out.append(f"t:dots={dots}")
    last = text[-1]
    kind = "end" if last in _TERMINAL and not dots else "digit" if last.isdigit() else "letter" if last.isalpha() else "comma" if last in ",;:，、；：" else "close" if last in ")]}”\"'»*$" else "other"
    out.append(f"t:last={kind}")
    out.append(f"t:lastchar={last if not last.isalpha() and not last.isdigit() else kind}")
    tail = _DIGITS.sub("0", text[-6:])
    out += [f"t:c{n}={tail[-n:]}" for n in (2, 3, 4)]
    segment = last_segment(text)
    tokens = [_shape(t) for t in _TAIL_TOKEN.findall(segment)]
    if len(tokens) <= 7:
        out.append("t:whole=" + " ".join(tokens))
        alone = "alone" if len(segment) == len(text) else "last"
        out.append(f"t:general={alone} " + " ".join("w" if t[0].isalpha() and i else t for i, t in enumerate(tokens)))
    out.append("t:first2=" + " ".join(tokens[:2]))
    out.append("t:first3=" + " ".join(tokens[:3]))
    out += [f"t:l{n}=" + " ".join(tokens[-n:]) for n in (1, 2, 3, 4)]
    out.append(f"t:size={min(len(tokens), 12)},{kind}")
    out.append(f"t:first2kind={' '.join(tokens[:2])},{kind}")
    out.append(f"t:state={think_state(text)},{kind},{bool(opened)},{dots}")
    after = text.rsplit("</think>", 1)[-1].strip()
    out.append(f"t:after={'nothing' if not after else 'short' if len(after) < 40 else 'long'},{kind}")
    return out


def clearly_cut(text: str) -> bool:
    return think_state(text) == "open" or bool(set(open_formula(text)) & {"{", "$", "\\(", "\\["})


def cut(text: str, rng: random.Random) -> str | None:
    """An intact text cut before its end: within a word, formula, sentence or open reasoning."""
    text = without_markers(text).rstrip()
    if len(text) < 12:
        return None
    bare = text[: len(text) - len(last_segment(text))]
    thought = text.find("</think>")
    stops = [m.start() + 1 for m in re.finditer(r"[.!?](?=\s)|[。！？]", text[:thought])] if thought > 0 else []
    if stops and rng.random() < 0.3:
        return text[: rng.choice(stops)] + rng.choice(("", "", " "))  # between two sentences of open reasoning
    for _ in range(12):
        at = rng.randrange(max(2, len(text) // 12), len(text)) if rng.random() < 0.7 else rng.randrange(max(2, len(text) - 60), len(text))
        head = text[:at]
        shown = head.rstrip()
        if not clearly_cut(head):
            if not shown or shown[-1] in _TERMINAL + ")]}”\"'>$*":
                continue
            if at >= len(bare) and not (head[-1].isalpha() and text[at].isalpha() and len(_TAIL_TOKEN.findall(text[len(bare) : at])) > 5):
                continue  # the closing statement so far may be complete as it is
            if len(last_segment(shown)) < 2 and not shown[-1].isalpha():
                continue
        elif shown.endswith("<think>"):
            continue
        draw = rng.random()
        if draw < 0.08 and shown:
            return shown + rng.choice(("...", "…"))
        if draw < 0.10:
            return head + "�"
        if draw < 0.2:
            return head + rng.choice(("<|im_end|>", "<|endoftext|>"))
        return head if draw < 0.6 else shown
    return None
