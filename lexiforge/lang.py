"""What differs between languages: lexicons, alphabets, thresholds. All operators take a profile."""

from __future__ import annotations

from dataclasses import dataclass

# Results depend on these lists, patterns and weights being just so.
FOREIGN_MARKERS = tuple("que de el la los las un una unos unas para con por más pero como este esta eso esa su sus del al lo le se me te nos ya hay fue son".split())
OWN_MARKERS = tuple(
    "eta ez baina dira dela direla zein nola egun orain gaur bihar baita nahiz dago dut naiz zara gara izan egin joan etorri ikusi eskerrik mesedez barkatu agur kaixo handi etxe urte mutil neska maite nahi badago horrela beraz ordea ostera adibidez gustoko halaber bertan hemen oraintxe".split()
)
SHORTCUTS = {
    "eskerrik": ("eskerik", "eskerik", "eskrrik"),
    "asko": ("asko", "askko", "ask"),
    "mesedez": ("mesedez", "mesede", "messedez"),
    "barkatu": ("barkat", "barkatu", "barcatu"),
    "agur": ("agur", "agru", "agr"),
    "kaixo": ("kaixo", "kaix", "kaixp", "kaixoo"),
    "egun": ("egn", "egun", "egn"),
    "orain": ("orain", "oraim", "orin"),
    "gaur": ("gaur", "garu", "gaut"),
    "bihar": ("bihar", "bihr", "biar"),
    "baina": ("baina", "bsina", "bina"),
    "beraz": ("beraz", "neraz", "bera"),
    "hala": ("hala", "hla", "hala"),
    "ere": ("ere", "erew", "ers"),
    "oso": ("oso", "os", "osoo"),
    "milesker": ("milesker", "mileskr", "milesker"),
    "eta": ("eta", "ta", "et"),
    "ez": ("ez", "ezz", "ez"),
}
ADJACENT = {
    "q": "wa12", "w": "qe23sa", "e": "wr34ds", "r": "et45fd", "t": "ry56gf", "y": "tu67hg", "u": "yi78jh", "i": "uo89kj", "o": "ip90lk", "p": "o0-l",
    "a": "qsz", "s": "awxd", "d": "secxf", "f": "drcvg", "g": "ftvbh", "h": "gybnj", "j": "hubmnk", "k": "jimol", "l": "kop",
    "z": "asx", "x": "zsdc", "c": "xdvfg", "v": "cfbg", "b": "vghn", "n": "bhjmk", "m": "njkl",
}
#: Upper bounds, out of 100, of accent drop, adjacent key, transpose, delete, insert and double.
RULE_BOUNDS = (20, 50, 65, 77, 88, 100)
EMOJI_RANGES = "\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F700}-\\x{1F77F}\\x{1F780}-\\x{1F7FF}\\x{1F800}-\\x{1F8FF}\\x{1F900}-\\x{1F9FF}\\x{1FA00}-\\x{1FA6F}\\x{1FA70}-\\x{1FAFF}\\x{2700}-\\x{27BF}\\x{2600}-\\x{26FF}\\x{FE00}-\\x{FE0F}\\x{1F1E6}-\\x{1F1FF}\\x{2B00}-\\x{2BFF}"
URL, MENTION, HASHTAG = r"https?://\S+|www\.\S+", r"@[\p{L}\p{N}_]+", r"#([\p{L}\p{N}_]+)"
ENTITY, TAG = r"&(?:amp|lt|gt|quot|apos|#39|#x27|nbsp);", r"<[^>]+>"
WORD_RUN = r"[\p{L}\p{N}_]+"
WORD_A = r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'-]*"
WORD_B = r"[A-ZÑÜÇa-zñüç][A-ZÑÜÇa-zñüç'\-]*"
ARTIFACT = r"^[A-ZÑÜÇa-zñüç]['\-]"
ELIGIBLE = r"^[A-Za-zÀ-ÿ'-]+$"
CHARS_A_TOKEN, PREFIX, MIN_CHARS, MIN_WORDS = 4, 200, 100, 3
FOREIGN_HITS, FOREIGN_SHARE = 5, 0.15
SCALE_BASE, SCALE_TOP = 1.15, 255
FIRST_SLOT, CHAR_A = 4, 182
XBU, XBC, XEC, FIRST_FREE = 174, 175, 176, 304
PAD, BOS, EOS, IGNORED = 0, 1, 2, -100
SYMBOL = r"(?s)<XBU>|<XBC>|<XEC>|<CHAR_[A-Z]>|."
SPACE_MARK = "▁"
FIRST_WORD = r"^[^\s.,!?;:\"'()«»\[\]{}]+"
WORD_EDGES = ".,!?;:\"'()«»[]{}"
#: A word with what stands before and after its letters, and the share of words that are typed wrong.
INLINE = r"^([^A-Za-zÀ-ÿ']*)([A-Za-zÀ-ÿ']+)([^A-Za-zÀ-ÿ']*)$"
TYPO_RATE = 0.33


@dataclass(frozen=True)
class Profile:
    foreign: tuple[str, ...] = FOREIGN_MARKERS
    own: tuple[str, ...] = OWN_MARKERS
    shortcuts: tuple = tuple(SHORTCUTS.items())


DEFAULT = Profile()
