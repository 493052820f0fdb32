"""Plain versions that operators are held against."""

import re

UNITS = set(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons oz lb lbs pound pounds ml cl l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years mph kmh percent usd eur dollar dollars euro euros cent cents degree degrees".split()
)
COUNTS = {w: str(n) for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
COUNTS |= {w: str(10 * n) for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)} | {"dozen": "12", "hundred": "100", "thousand": "1000", "million": "1000000"}
SIGNS = r"""[!-/:-@\[-`{-~“”„«»‘’¡¿…–—]*"""
OPERATORS = "+=×÷^<>±≤≥≠−"


def read(text):
    """(kind, value, whether it begins a sentence) of a text's tokens: n(umber), u(nit), C(apital word), w(ord)."""
    out, begins = [], True
    for word in text.split():
        core = re.fullmatch(rf"{SIGNS}(.*?){SIGNS}", word, re.S)[1]
        made = []
        if not core:
            made = [("w", word)] if len(word) == 1 and word in OPERATORS else []
        elif re.fullmatch(r"[+-]?[$€£]?\d[\d.,:/]*%?", core):
            made = [("n", core)]
        elif core.lower() in COUNTS:
            made = [("n", COUNTS[core.lower()])]
        elif (m := re.match(r"([+-]?[$€£]?\d[\d.,]*)([a-zA-Z]+)$", core)) and m[2].lower() in UNITS:
            made = [("n", m[1]), ("u", m[2].lower())]
        elif re.fullmatch(rf"[-+−]?\d[\d.,]*(?:[-*/{OPERATORS}]\d[\d.,]*)+=?", core):
            made = [("n" if x[0].isdigit() else "w", x) for x in re.findall(rf"\d[\d.,]*|[-*/{OPERATORS}]", core)]
        elif (m := re.fullmatch(r"(\w+ty)-(\w+)", core.lower())) and m[1] in COUNTS and int(COUNTS.get(m[2], 0)) in range(1, 10):
            made = [("n", str(int(COUNTS[m[1]]) + int(COUNTS[m[2]])))]
        else:
            made = [("C" if core[:1].isupper() and core[1:].islower() else "w", core.lower())]
        for k, (kind, value) in enumerate(made):
            if kind in "Cw" and out and out[-1][0] == "n" and value in UNITS:
                kind = "u"
            out.append((kind, value, begins and k == 0))
        begins = word[-1] in ".!?:" or begins and not made
    return out


def held(text, items):
    """(item, tokens covered, its tokens) of the items (id, text) that a text holds: each item is laid beside each place."""
    own, out = read(text.decode("utf-8", "replace")), []
    for item, other in items:
        theirs = read(other.decode("utf-8", "replace"))
        n = len(theirs)
        size = min(8, n)
        if not size:
            continue
        covered = set()
        for shift in range(size - n, len(own) - size + 1):
            there, back, here = {}, {}, set()
            for exact in (False, True):
                for at in range(n - size + 1):
                    if not 0 <= shift + at <= len(own) - size:
                        continue
                    pairs = list(zip(theirs[at : at + size], own[shift + at : shift + at + size], strict=True))
                    if exact:
                        fits = all(a[1] == b[1] for a, b in pairs)
                        slots = [(a[0], a[1], b[1]) for a, b in pairs if a[0] != "w"]
                    else:
                        words = [a[0] in "wC" and b[0] == "w" and a[1] == b[1] and (a[0] == "w" or a[2]) for a, b in pairs]
                        fits = all(w or a[0] == b[0] != "w" for w, (a, b) in zip(words, pairs, strict=True)) and sum(words) >= min(2, size)
                        slots = [(a[0], a[1], b[1]) for w, (a, b) in zip(words, pairs, strict=True) if not w]
                    one, two = dict(there), dict(back)
                    if fits and all(one.setdefault((k, x), y) == y and two.setdefault((k, y), x) == x for k, x, y in slots):
                        there, back = one, two
                        here |= set(range(at, at + size))
                        if exact or sum(words) >= min(4, size):
                            covered |= set(range(at, at + size))
            if len(here) == n:
                covered = here
                break
        if len(covered) >= min(13, 0.5 * n):
            out.append((item, len(covered), n))
    return out
