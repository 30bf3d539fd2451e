"""Which characters look alike: invisible ones, blanks, width forms, letters of other alphabets."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

# Characters that take no room.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]
# Characters shown as one blank.
BLANKS = [0x09, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
# Letters of other alphabets and the Latin letters of the same shape, pairwise.
SAME_SHAPE = {
    "cyrillic": ("АВЕЗІЇЈКМНОРСТУХЅԚԜҮаеёіїјорсухѕһԁԛԝүҺӀ", "ABE3IÏJKMHOPCTYXSQWYaeëiïjopcyxshdqwyhl"),
    "greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανοριϲυχϳ", "ABEZHIKMNOPTYXavopicuxj"),
    "latin": ("ıɑɡɩ", "iagi"),
    "armenian": ("ՍՏՕԼհոսօց", "USOLhnuog"),
    "coptic": ("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲬⲟⲣⲥⲭ", "HIKMNOPCTXopcx"),
    "cherokee": ("ᎪᎠᎡᎢᎩᎫᎬᎳᎷᎻᏃᏏᏒᏔᏙᏚᏞᏟᏢᏦᏴ", "ADRTYJEWMHZbRWVSLCPKB"),
}


def _pairs() -> dict[str, str]:
    pairs: dict[str, str] = {}
    for others, latin in SAME_SHAPE.values():
        pairs.update((a, b) for a, b in zip(others, latin) if not b.isdigit())
    return pairs


@lru_cache(1)
def prototypes() -> np.ndarray:
    """Code point -> code point of its prototype; 0 means: drop it."""
    to = np.arange(0x110000, dtype=np.uint32)
    for i in range(0xFF01, 0xFF5F):
        to[i] = i - 0xFEE0
    to[BLANKS] = 0x20
    for a, b in _pairs().items():
        if len(unicodedata.normalize("NFD", b)) == 1:
            to[ord(a)] = ord(b)
    to[INVISIBLE] = 0
    to[0] = 0
    return to
