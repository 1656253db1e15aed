"""Masking of variable values in log messages: native column expressions, composed in chains."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word boundary over ASCII words; Java's own is Unicode-aware.
WB = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: The same before and behind what is a word character itself.
BEFORE, BEHIND = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_X, _U, _L = r"[0-9A-Fa-f]", "[A-Z]", "[a-z]"
_OCTET = r"(?:25[0-5]|(?:2[0-4]|1\d|[1-9])?\d)"
_REAL = r"\d+(?:[.]\d+)?"
_D2, _D4 = r"\d{2}", r"\d{4}"
_CLOCK = f"{_D2}:{_D2}:{_D2}"
#: What a number stands between.
LEFT, RIGHT = r"""\s#%@.:'"/(=\\""", r"""\s#%@,:'"/)\\"""
_H = _X + "{1,4}"
_END = r"(?![\w:])"


@dataclass(frozen=True)
class Mask:
    """A pattern, what its matches are replaced by, and the group that extraction gives."""

    name: str
    pattern: str
    replacement: str = r"\$v"
    group: int = 0
    #: Every match holds one of these, so texts without them needn't be searched; none given: all are.
    needs: tuple[str, ...] = ()

    def __call__(self, text: Column) -> Column:
        return F.regexp_replace(text, self.pattern, self.replacement)

    def where_needed(self, text: Column) -> Column:
        """The same, searched only where a match can be. The text is evaluated once."""
        if not self.needs:
            return self(text)
        some = lambda x: reduce(Column.__or__, [x.contains(n) for n in self.needs])
        return F.get(F.transform(F.array(text), lambda x: F.when(some(x), self(x)).otherwise(x)), F.lit(0))

    def extract(self, text: Column) -> Column:
        """All values that the mask would replace, as an array."""
        if self.group < 0:
            return F.transform(F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0)), lambda x: F.lit(""))
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(self.group))


def regex_mask(pattern: str, replacement: str = r"\$v", group: int = 0, name: str = "custom") -> Mask:
    """A mask of one's own; pattern and replacement in Java's syntax."""
    return Mask(name, pattern, replacement, group)


def ipv6_pattern() -> str:
    """IPv6 addresses: eight groups, or one `::` and at most five group colons, on boundaries that exclude colons.

    An address in brackets with a port is matched with both; groups 1 and 2 hold the address and what follows it.
    """
    short = "|".join(rf"(?:{_H}:){{{a}}}:(?:(?:{_H}:){{0,{5 - a}}}{_H}{_END}|{_END})" for a in range(1, 6))
    body = rf"(?:(?:{_H}:){{7}}{_H}{_END}|{short}|::(?:{_H}:){{0,5}}{_H}{_END})"
    return rf"\[(?={body}\]:\d{{1,5}}{_END})[0-9A-Fa-f:]+\]:\d{{1,5}}|(?<![\w:]){body}"


EXTENDED_DATE = Mask("extended_date", rf"{BEFORE}(?:{_U}{_L}{{2}}\s+){{2}}\d{{2}}(?:\s+\d{{4}})?\s+{_CLOCK}(?:\s+{_U}{{3}}(?:\+\d{{4}})?)?(?:\s+\d{{4}})?{BEHIND}", needs=(":",))
LONG_DATE = Mask("long_date", rf"{BEFORE}(?:{_U}{_L}{{2}}\s+){{0,2}}\d{{4}}-\d{{2}}-\d{{2}}\s+{_CLOCK}(?:\s+{_U}{{3}})?{BEHIND}", needs=("-",))
DATE = Mask("date", rf"{BEFORE}\d{{2}}/\d{{2}}/\d{{2}}{BEHIND}", needs=("/",))
TIME = Mask("time", rf"{BEFORE}{_CLOCK}{BEHIND}", needs=(":",))
UUID = Mask("uuid", rf"{WB}\{{?{_X}{{8}}-(?:{_X}{{4}}-){{3}}{_X}{{12}}\}}?{WB}", needs=("-",))
LIBVIRTD = Mask("libvirtd", rf"^{_D4}-{_D2}-{_D2} {_CLOCK}[.]\d{{3}}[+]{_D4}: \d+:", needs=("+",))
IPV6 = Mask("ipv6", ipv6_pattern(), needs=(":",))
AUDIT = Mask("linux_kernel_audit", rf"{BEFORE}audit[(]\d+[.]\d+:\d+[)]", r"audit(\$v)", needs=("audit(",))
MEM_SIZE = Mask("linux_mem_size", rf"(?i){BEFORE}{_REAL}\s*[KMG]{BEHIND}", needs=("G", "K", "M", "g", "k", "m"))
DATA_SIZE = Mask("data_size", rf"(?i){BEFORE}{_REAL}\s*[KMGTP]?i?B{BEHIND}", needs=("B", "b"))
DURATION = Mask("time_duration", rf"{WB}-?{_REAL}\s*(?:m?s|seconds?){BEHIND}", needs=("s",))
_at = lambda letter, times="?": rf"(?:{letter}\d+){times}"
_SLOT, _USB = _at("p") + r"s\d+" + _at("f") + _at("d"), r"p\d+s\d+" + _at("f") + _at("u", "*") + _at("c") + _at("i")
NETIF = Mask("linux_netif", rf"{BEFORE}(?:{_at('P')}(?:en|w[lw])(?:x{_X}{{12}}|o\d+|{_SLOT}|{_USB})|(?:eth|wlan|wwan)\d+){BEHIND}", needs=("en", "wl", "ww", "eth"))
MAC = Mask("mac_address", rf"{BEFORE}(?:{_X}{{2}}[:-]){{5}}{_X}{{2}}{BEHIND}", needs=(":", "-"))
IPV4 = Mask("ipv4_address", rf"{BEFORE}(?:{_OCTET}\.){{3}}{_OCTET}(?::\d{{1,5}})?{BEHIND}", needs=(".",))
HEX = Mask("hexadec_constant", rf"{BEFORE}0x{_X}+{BEHIND}", needs=("0x",))
SQUARE = Mask("square_bracket", r"\[.*?\]", r"[\$v]", needs=("[",))
POINTED = Mask("pointed_bracket", r"<.*?>", r"<\$v>", needs=("<",))
NUMBER = Mask("number_constant", rf"(^|[{LEFT}])(-?\d+)(?=[{RIGHT}]|$)", r"$1\$v", 2)
#: Extraction gives an empty string per match: the values it names don't exist in the pattern.
AGGRESSIVE_NUMBER = Mask("aggressive_number_constant", rf"{WB}-?\d+{BEHIND}", r"\$v", -1)
SEPARATION = Mask("separation_inserter", r"""([.,:=/'"\\])([A-Za-z0-9])""", "$1 $2", 0)

MASKS = {m.name: m for m in (EXTENDED_DATE, LONG_DATE, DATE, TIME, UUID, LIBVIRTD, IPV6, AUDIT, MEM_SIZE, DATA_SIZE, DURATION, NETIF, MAC, IPV4, HEX, SQUARE, POINTED, NUMBER, AGGRESSIVE_NUMBER, SEPARATION)}


class MaskChain:
    """Masks given in the order of their construction; the last one added runs first."""

    def __init__(self, *masks: Mask):
        self._given = list(masks)

    def add(self, mask: Mask) -> MaskChain:
        return MaskChain(*self._given, mask)

    @property
    def order(self) -> Sequence[Mask]:
        """The order of execution."""
        return self._given[::-1]

    def __call__(self, text: Column) -> Column:
        return reduce(lambda c, m: m.where_needed(c), self.order, text)

    def extract(self, text: Column) -> Column:
        """What each stage takes out of what the one before left, in one array."""
        found, now = [], text
        for mask in self.order:
            found.append(mask.extract(now))
            now = mask(now)
        return F.concat(*found)


#: The chain of the template miner and of flat and by-process clustering, and that of nested clustering.
_COMMON = (POINTED, SQUARE, HEX, IPV4, MAC, NETIF, DURATION, DATA_SIZE, MEM_SIZE, AUDIT, IPV6, LIBVIRTD, UUID, TIME, DATE, LONG_DATE, EXTENDED_DATE)
DEFAULT = MaskChain(NUMBER, *_COMMON)
NESTED = MaskChain(AGGRESSIVE_NUMBER, *_COMMON)
