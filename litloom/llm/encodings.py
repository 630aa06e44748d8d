"""How text comes to be garbled: chains of encodings, their inverses, and what garbled text looks like."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Single-byte decoders that text is wrongly read with.
READ_AS = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "koi8_r", "cp866", "iso8859_2", "iso8859_15")
#: Encodings the text truly had, where it was no UTF-8.
WRITTEN_AS = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "koi8_r", "cp866")
WIDE = ("gbk", "big5")
LOST = "�"
RUN = re.compile(r"[^\x00-\x7f]+")
REFERENCE = re.compile(r"&#(?:x([0-9a-fA-F]{1,6})|(\d{1,7}));")
#: Text shown as an example of characters, which is no text of the document.
QUOTED = re.compile(r"`[^`\n]+`")
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _table(codec: str) -> dict[int, str]:
    """Characters that the decoder gives for the upper half, as the byte they came from.  C1 controls
    stand for their bytes, as sloppy decoders leave them."""
    table = {code: chr(code) for code in range(0x80, 0xA0)}
    for byte in range(0x80, 0x100):
        try:
            table[ord(bytes([byte]).decode(codec))] = chr(byte)
        except UnicodeDecodeError:
            pass
    return table


_BYTES = {codec: _table(codec) for codec in READ_AS}
_KNOWN = {codec: frozenset(map(chr, table)) for codec, table in _BYTES.items()}


def _pair(read: str, written: str) -> dict[int, str]:
    table = {}
    for char, byte in _BYTES[read].items():
        try:
            table[char] = byte.encode("latin-1").decode(written)
        except UnicodeDecodeError:
            pass
    return table


_PAIRS = {f"{w} as {r}": _pair(r, w) for r in READ_AS for w in WRITTEN_AS if w != r and (w, r) != ("cp1252", "iso8859_15")}

TABLES = len(_PAIRS)


def _utf8(run: str, codec: str) -> str | None:
    """The run with every UTF-8 sequence that the codec's bytes form; None if there is none."""
    table = _BYTES[codec]
    raw = "".join(table.get(ord(ch), "\x00") for ch in run)
    out, last, hits = [], 0, 0
    for m in _UTF8.finditer(raw):
        try:
            char = m[0].encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += [run[last:m.start()], char]
        last = m.end()
        hits += 1
    return "".join([*out, run[last:]]) if hits else None


def _any_case(run: str) -> str | None:
    """UTF-8 read as cp1252 whose case was changed afterwards."""
    table, out, i, hits = _BYTES["cp1252"], [], 0, 0

    def options(ch: str) -> list[int]:
        return [ord(table[ord(c)]) for c in dict.fromkeys((ch, ch.upper(), ch.lower())) if len(c) == 1 and ord(c) in table]

    while i < len(run):
        done = False
        for lead in options(run[i]):
            n = 1 if 0xC2 <= lead <= 0xDF else 2 if 0xE0 <= lead <= 0xEF else 3 if 0xF0 <= lead <= 0xF4 else 0
            follow = [[b for b in options(ch) if 0x80 <= b <= 0xBF] for ch in run[i + 1:i + 1 + n]]
            if n and len(follow) == n and all(follow):
                try:
                    char = bytes([lead, *[f[0] for f in follow]]).decode("utf-8")
                except UnicodeDecodeError:
                    continue
                out.append(char)
                i += n + 1
                hits += 1
                done = True
                break
        if not done:
            out.append(run[i])
            i += 1
    return "".join(out) if hits else None


def _wide_bytes(run: str, codec: str) -> str | None:
    """UTF-8 read as a two-byte encoding; what was cut at the end stays lost."""
    try:
        raw = run.replace(LOST, "").encode(codec)
    except UnicodeEncodeError:
        return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("utf-8", "replace")
        return text if text.count(LOST) <= 1 + len(text) // 4 and LOST not in text[:1] else None


@lru_cache(maxsize=60_000)
def restorations(run: str, blank: bool = False) -> tuple[tuple[str, str], ...]:
    """(chain, restored run) of all chains that can have made the run.  ``blank``: a blank follows,
    which can be what is left of a no-break space."""
    found: dict[str, str] = {}
    chars = set(run)
    for codec in READ_AS:
        known = chars & _KNOWN[codec]
        if not known:
            continue
        once = _utf8(run, codec)
        if once is not None:
            found[f"utf8 as {codec}"] = once
            again, times = _utf8(once, codec), 2
            while again is not None and times < 5:
                found[f"utf8 as {codec} x{times}"] = again
                again, times = _utf8(again, codec), times + 1
    if chars & _KNOWN["cp1252"]:
        if "utf8 as cp1252" not in found and (other := _any_case(run)) is not None:
            found["utf8 as cp1252, other case"] = other
        if blank and (whole := _utf8(run + "\xa0", "cp1252")) is not None and not whole.endswith("\xa0"):
            found["utf8 as cp1252, blank"] = whole
        if chars <= _KNOWN["cp1252"] and len(run) > 1:
            raw = "".join(_BYTES["cp1252"][ord(c)] for c in run).encode("latin-1")
            for codec in WIDE:
                try:
                    found[f"{codec} as cp1252"] = raw.decode(codec)
                except UnicodeDecodeError:
                    pass
    if any("⺀" <= ch <= "￮" for ch in chars):
        for codec in WIDE:
            if (text := _wide_bytes(run, codec)) is not None:
                found[f"utf8 as {codec}"] = text
    for chain, table in _PAIRS.items():
        if chars <= _KNOWN[chain.rpartition(" ")[2]]:
            found[chain] = run.translate(table)
    return tuple((chain, text) for chain, text in found.items() if text != run)


@lru_cache(maxsize=200_000)
def kind(ch: str) -> str:
    """l/u ASCII letter, d digit, b blank, p ASCII mark; L/U other Latin letter, C/K Cyrillic, H common
    and h other Chinese, q punctuation, r opening punctuation, s symbol, m combining mark, x never text, o other
    scripts in wide use, y the rest."""
    code = ord(ch)
    if code < 128:
        return "l" if ch.islower() else "u" if ch.isupper() else "d" if ch.isdigit() else "b" if ch.isspace() else "p"
    if ch == LOST:
        return "x"
    category = unicodedata.category(ch)
    if category in ("Cc", "Cn", "Co", "Cs") or ch == "\xad":
        return "x"
    if "一" <= ch <= "鿿":
        try:  # the first level of GB 2312 holds the characters in common use
            return "H" if 0xB0 <= ch.encode("gb2312")[0] <= 0xD7 else "h"
        except UnicodeEncodeError:
            return "h"
    if 0x300 <= code < 0x370:
        return "m"  # a mark on the letter before
    if category[0] == "L":
        name = unicodedata.name(ch, "")
        if ch in "ªº":
            return "s"
        if name.startswith("LATIN"):
            return "U" if category == "Lu" else "L"
        if name.startswith("CYRILLIC"):
            # letters that Russian lacks come from wrong tables more often than from text
            return "k" if not ("а" <= ch.lower() <= "я" or ch in "ёЁ") else "K" if category == "Lu" else "C"
        return "o" if name.startswith(SCRIPTS) else "y"
    if category[0] in "PSN" and 0x2800 <= code < 0x2E80:
        return "y"
    if category[0] in "PSN" and not (code < 0x100 or 0x2000 <= code < 0x2600 or 0x3000 <= code < 0x3030 or 0xFF00 <= code):
        return "o"  # marks of other scripts
    if category in ("Ps", "Pi") or ch in "¿¡‚":
        return "r"
    if category[0] == "P":
        return "q"
    if category[0] in "SN":
        return "s" if code < 0x2E80 else "o"
    return "b" if category == "Zs" else "o"


_LATIN, _OTHER, _CYRILLIC = set("luLU"), set("LU"), set("CKk")
_LETTER = set("luLUCKk")
_ALONE = {"x": 6.0, "h": 1.5, "k": 1.0, "o": 1.0, "y": 3.0}
SCRIPTS = ("GREEK", "HIRAGANA", "KATAKANA", "HANGUL", "BOPOMOFO", "ARABIC", "HEBREW", "MODIFIER")


@lru_cache(maxsize=20_000)
def _odd(a: str, b: str) -> float:
    """How odd two kinds of characters are side by side."""
    cost = 0.0
    if a in "lL" and b == "U" or a == "C" and b == "K":
        cost += 3
    if a in _OTHER and b in _OTHER:
        cost += 0.7 if a == b == "U" else 1.5
    if a in _LATIN and b in _CYRILLIC or b in _LATIN and a in _CYRILLIC:
        cost += 3
    if a in _OTHER and b in "Hh" or b in _OTHER and a in "Hh":
        cost += 3
    if a in "oy" and b in _LETTER or b in "oy" and a in _LETTER:
        cost += 3
    if a in _CYRILLIC and b in "Hh" or b in _CYRILLIC and a in "Hh":
        cost += 3
    if a == "s" and b in _LETTER or b == "s" and a in _LETTER:
        cost += 1.5
    if a in _LETTER and b == "r":
        cost += 2
    if a in "sqr" and b in "sqr":
        cost += 1 if "s" in (a, b) else 0.3
    if a in _OTHER and b in "sqr" or b in _OTHER and a in "sqr":
        cost += 1
    return cost


def structure(left: str, run: str, right: str) -> float:
    """Log-likelihood, up to a constant, of the shapes of a run between its neighbours."""
    kinds = [kind(left), *map(kind, run), kind(right)]
    return -0.5 * len(run) - sum(_ALONE.get(k, 0.0) for k in kinds[1:-1]) - sum(map(_odd, kinds, kinds[1:]))
