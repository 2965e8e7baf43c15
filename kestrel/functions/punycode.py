"""Bootstring (RFC 3492) with the parameters of Punycode."""

from __future__ import annotations

#: Fixed values of the RFC.
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
LARGEST = 0x10FFFF


def _adapted(delta: int, points: int, first: bool) -> int:
    """The bias after a delta was spelt."""
    delta = delta // DAMP if first else delta // 2
    delta += delta // points
    steps = 0
    while delta > (BASE - T_MIN) * T_MAX // 2:
        delta //= BASE - T_MIN
        steps += BASE
    return steps + (BASE - T_MIN + 1) * delta // (delta + SKEW)


def _threshold(place: int, bias: int) -> int:
    return min(max(place - bias, T_MIN), T_MAX)


def encode(label: str) -> str:
    """A label in Punycode, without xn--.

    Characters beyond ASCII are put in by code point, then by place. Between two of them the distance counts all states that
    lie between: a place for each character put in so far, for each code point passed over.
    """
    basic = [c for c in label if c.isascii()]
    out = "".join(basic) + "-" * bool(basic)
    later = sorted((ord(c), k) for k, c in enumerate(label) if not c.isascii())
    done, code, delta, bias = len(basic), FIRST_CODE, 0, FIRST_BIAS
    last = -1  # place of the character put in before, of the same code point
    for point, place in later:
        if point > code:
            # the rest of the code point before, whole rounds, and a start from the first place
            delta += sum(ord(c) < code for c in label[last + 1 :]) if last >= 0 else 0
            delta += (point - code - (last >= 0)) * (done + 1) + (last >= 0)
            code, last = point, -1
        delta += sum(ord(c) < code for c in label[last + 1 : place])
        digits, rest, at = "", delta, BASE
        while rest >= (t := _threshold(at, bias)):
            digits += DIGITS[t + (rest - t) % (BASE - t)]
            rest = (rest - t) // (BASE - t)
            at += BASE
        out += digits + DIGITS[rest]
        bias = _adapted(delta, done + 1, done == len(basic))
        done, delta, last = done + 1, 0, place
    return out


def decode(text: str) -> str | None:
    """The label of Punycode without xn--; None if it isn't any."""
    basic, _, spelt = text.rpartition("-")
    if not text.isascii():
        return None
    out, at, code, bias = list(basic), 0, FIRST_CODE, FIRST_BIAS
    k = 0
    while k < len(spelt):
        before, weight, place = at, 1, BASE
        while True:
            digit = DIGITS.find(spelt[k].lower()) if k < len(spelt) else -1
            if digit < 0:
                return None
            k += 1
            at += digit * weight
            t = _threshold(place, bias)
            if digit < t:
                break
            weight *= BASE - t
            place += BASE
        bias = _adapted(at - before, len(out) + 1, before == 0)
        code += at // (len(out) + 1)
        at %= len(out) + 1
        if code > LARGEST:
            return None
        out.insert(at, chr(code))
        at += 1
    return "".join(out)
