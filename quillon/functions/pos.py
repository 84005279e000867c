"""Parts of speech: packed attribute layouts, their decoding, descriptions and the tab lines that define them.

A packed value holds the part of speech in its low five bits, then the fields of that part in order. Deviations from the
published tables, all on purpose: English `m` and `f` mean masculine and feminine, and `aa` counts as a main form.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Language:
    tags: tuple[str, ...]
    titles: tuple[str, ...]
    layouts: dict[str, tuple[tuple[str, int], ...]]  # field, bits
    values: dict[str, dict[int, str]]
    shown: dict[str, tuple[str, ...]]
    words: dict[str, tuple[str, str, int]]  # attribute -> field, how, value
    types: dict[str, tuple[str, dict[str, int]]]  # tab type -> part, forced fields
    main_codes: frozenset[str]


_R = {"number": 2, "lang": 2, "gender": 3, "case": 4, "entity": 3, "animation": 2, "time": 3, "person": 3, "voice": 2}


def _layout(names: str, bits: dict[str, int]) -> tuple[tuple[str, int], ...]:
    return tuple((n, bits.get(n, 1)) for n in names.split())


# The Russian model.
_POOR = ("preposition", "conjunction", "interjection", "particle", "introductory")
RUSSIAN = Language(
    tags=(
        "unknown", "noun", "adjective", "pronoun_noun", "verb", "participle", "adverb_participle", "pronoun_predicative",
        "pronoun_adjective", "numeral", "numeral_ordinal", "adverb", "predicate", *_POOR,
    ),
    titles=(
        "неизвестная часть речи", "существительное", "прилагательное", "местоимение-существительное", "глагол", "причастие",
        "деепричастие", "местоимение-предикатив", "местоименное прилагательное", "числительное (количественное)",
        "порядковое числительное", "наречие", "предикатив", "предлог", "союз", "междометие", "частица", "вводное слово",
    ),
    layouts={
        "noun": _layout("number lang gender case entity", _R),
        "adjective": _layout("number lang gender case animation brevity", _R),
        "pronoun_noun": _layout("number lang gender case person", _R),
        "verb": _layout("number lang time voice person gender impersonal", _R),
        "participle": _layout("number lang time voice case gender animation", _R),
        "adverb_participle": _layout("lang time voice", _R),
        "pronoun_predicative": _layout("number lang case", _R),
        "pronoun_adjective": _layout("number lang gender case animation", _R),
        "numeral": _layout("lang gender case", _R),
        "numeral_ordinal": _layout("number lang gender case animation", _R),
        "adverb": _layout("lang relativity questionarity brevity", _R),
        "predicate": _layout("lang time unchanged", _R),
        **{p: _layout("lang", _R) for p in _POOR},
    },
    values={
        "number": {0: "неизвестное число", 1: "единственное число", 2: "множественное число"},
        "lang": {1: "профессионализм", 2: "архаизм", 3: "неформальный язык"},
        "gender": {0: "неизвестный род", 1: "мужской род", 2: "женский род", 4: "средний род"},
        "case": {
            0: "неизвестный падеж", 1: "именительный падеж", 2: "родительный падеж", 3: "второй родительный падеж",
            4: "дательный падеж", 5: "винительный падеж", 6: "творительный падеж", 7: "предложный падеж",
            8: "второй предложный падеж", 9: "звательный падеж",
        },
        "time": {0: "неизвестное время", 1: "настояшее время", 2: "будущее время", 4: "прошедшее время"},
        "person": {0: "неизвестное лицо", 1: "первое лицо", 2: "второе лицо", 4: "третье лицо"},
        "entity": {1: "аббревиатуры", 2: "имена", 3: "отчества", 4: "фамилии"},
        "animation": {0: "неизвестная характеристика", 1: "одушевленный", 2: "неодушевленный"},
        "voice": {0: "неизвестный залог", 1: "действительный залог", 2: "страдательный залог"},
        "impersonal": {0: "личная форма", 1: "безличная форма"},
        "relativity": {0: "неотносительное", 1: "относительное"},
        "questionarity": {0: "невопросительное", 1: "вопросительное"},
        "unchanged": {0: "изменяемое", 1: "неизменяемое"},
        "brevity": {1: "краткое"},
        "brevity@adverb": {0: "некраткое", 1: "краткое"},
    },
    shown={
        "noun": ("number", "gender", "case", "lang", "entity"),
        "adjective": ("number", "gender", "case", "animation", "lang", "brevity"),
        "pronoun_noun": ("number", "gender", "case", "person", "lang"),
        "verb": ("number", "time", "voice", "person", "gender", "impersonal", "lang"),
        "participle": ("number", "time", "voice", "case", "gender", "animation", "lang"),
        "adverb_participle": ("time", "voice", "lang"),
        "pronoun_predicative": ("number", "case", "lang"),
        "pronoun_adjective": ("number", "gender", "case", "animation", "lang"),
        "numeral": ("gender", "case", "lang"),
        "numeral_ordinal": ("number", "gender", "case", "animation", "lang"),
        "adverb": ("relativity", "questionarity", "brevity", "lang"),
        "predicate": ("time", "unchanged", "lang"),
        **{p: ("lang",) for p in _POOR},
    },
    words={
        "мр": ("gender", "set", 1), "жр": ("gender", "set", 2), "ср": ("gender", "set", 4),
        "ед": ("number", "set", 1), "мн": ("number", "set", 2),
        "им": ("case", "set", 1), "рд": ("case", "set", 2), "дт": ("case", "set", 4), "вн": ("case", "set", 5),
        "тв": ("case", "set", 6), "пр": ("case", "set", 7), "зв": ("case", "set", 9),
        "проф": ("lang", "set", 1), "жарг": ("lang", "set", 1), "арх": ("lang", "set", 2), "разг": ("lang", "set", 3),
        "нст": ("time", "set", 1), "буд": ("time", "set", 2), "прш": ("time", "set", 4),
        "1л": ("person", "set", 1), "2л": ("person", "set", 2), "3л": ("person", "set", 4),
        "аббр": ("entity", "set", 1), "имя": ("entity", "set", 2), "отч": ("entity", "set", 3), "фам": ("entity", "set", 4),
        "од": ("animation", "set", 1), "но": ("animation", "set", 2), "дст": ("voice", "set", 1), "стр": ("voice", "set", 2),
        "безл": ("impersonal", "set", 1), "кр": ("brevity", "set", 1), "относ": ("relativity", "set", 1),
        "вопр": ("questionarity", "set", 1), "0": ("unchanged", "set", 1),
    },
    types={
        "С": ("noun", {}), "П": ("adjective", {}), "МС": ("pronoun_noun", {}), "Г": ("verb", {}), "ПРИЧАСТИЕ": ("participle", {}),
        "ДЕЕПРИЧАСТИЕ": ("adverb_participle", {}), "ИНФИНИТИВ": ("verb", {"gender": 0}), "МС-ПРЕДК": ("pronoun_predicative", {}),
        "МС-П": ("pronoun_adjective", {}), "ЧИСЛ": ("numeral", {}), "ЧИСЛ-П": ("numeral_ordinal", {}), "Н": ("adverb", {}),
        "ПРЕДК": ("predicate", {}), "ПРЕДЛ": ("preposition", {}), "СОЮЗ": ("conjunction", {}), "МЕЖД": ("interjection", {}),
        "ЧАСТ": ("particle", {}), "ВВОДН": ("introductory", {}), "КР_ПРИЛ": ("adjective", {"brevity": 1}), "КР_ПРИЧАСТИЕ": ("participle", {}),
    },
    main_codes=frozenset(
        "ша шж шт шм чж аа Юо го ва во га Йа Йм еа Яз иж ао ап ат ау ац ач аъ бо бН вН вО до дН Ра Рж Та Тж йа иа нр ка кн "
        "ко Эт Эу ла ма па са ча ыа ыш ыь эа Ца эж юа яа яб яв яг яе яд яё яж яз яй".split()
    ),
)

# The English model.
_E = {"number": 4, "gender": 2, "case": 2, "animation": 2, "type": 3, "degree": 2, "time": 3, "person": 3, "form": 2}
ENGLISH = Language(
    tags=(
        "unknown", "adjective", "adverb", "verb", "numeral", "numeral_ordinal", "conjunction", "interjection", "preposition",
        "particle", "article", "noun", "pronoun", "pronoun_noun", "pronoun_adjective", "possessive",
    ),
    titles=(
        "unknown part of speech", "adjective", "abverb", "verb", "numeral", "numeral-ordinal", "conjuction", "interjection",
        "preposition", "particle", "article", "noun", "pronoun", "pronoun-noun", "pronoun-adjective", "possesive",
    ),
    layouts={
        "noun": _layout("number gender case animation type narrative", _E),
        "adjective": _layout("degree prop", _E),
        "verb": _layout("time gender person", _E),
        "adverb": _layout("degree", _E),
        "pronoun": _layout("number case type person", _E),
        "pronoun_adjective": _layout("number form type", _E),
    },
    values={
        "number": {0: "unknown number", 1: "singular number", 2: "plural number", 4: "uncount number", 8: "mass number"},
        "gender": {0: "unknown gender", 1: "masculine gender", 2: "feminine gender", 3: "neuter gender"},
        "case": {0: "unknown case", 1: "nominative case", 2: "object case"},
        "animation": {0: "unknown animation", 1: "animate animation", 2: "inanimate animation"},
        "type": {0: "unknown pronoun type", 1: "personal pronoun type", 2: "possessive pronoun type", 3: "reflexive pronoun type", 4: "demostrative pronoun type"},
        "degree": {0: "unknown degree", 1: "positive degree", 2: "comparative degree", 3: "superlative degree"},
        "time": {
            0: "unknown time", 1: "infinitive time", 2: "present time", 3: "past time", 4: "future to be time",
            5: "past participle time", 6: "gerund time", 7: "if to be time",
        },
        "person": {0: "unknown person", 1: "first person", 2: "second person", 4: "third person"},
        "form": {0: "unknown pronoun form", 1: "predicative pronoun form", 2: "attributive pronoun form"},
        "narrative": {1: "narrative"},
        "prop": {1: "propper name"},
    },
    shown={
        "noun": ("number", "gender", "case", "animation", "type", "narrative"),
        "adjective": ("degree", "prop"),
        "verb": ("time", "gender", "person"),
        "adverb": ("degree",),
        "pronoun": ("number", "case", "type", "person"),
        "pronoun_adjective": ("number", "form", "type"),
    },
    words={
        "m": ("gender", "set", 1), "f": ("gender", "set", 2),
        "sg": ("number", "or", 1), "pl": ("number", "set", 2), "uncount": ("number", "set", 4), "mass": ("number", "set", 8),
        "inf": ("time", "set", 1), "prsa": ("time", "set", 2), "pasa": ("time", "set", 3), "fut": ("time", "set", 4),
        "pp": ("time", "set", 5), "ing": ("time", "set", 6), "if": ("time", "set", 7),
        "nom": ("case", "set", 1), "obj": ("case", "set", 2),
        "pos": ("degree", "set", 1), "comp": ("degree", "set", 2), "sup": ("degree", "set", 3),
        "pred": ("form", "set", 1), "attr": ("form", "set", 2),
        "pers": ("type", "set", 1), "poss": ("type", "set", 2), "ref": ("type", "set", 3), "dem": ("type", "set", 4),
        "1": ("person", "or", 1), "2": ("person", "or", 2), "3": ("person", "or", 4),
        "narr": ("narrative", "set", 1), "anim": ("animation", "set", 1),
    },
    types={
        "NOUN": ("noun", {"type": 0}), "ADJECTIVE": ("adjective", {}), "ADVERB": ("adverb", {}), "VERB": ("verb", {}), "MOD": ("verb", {}),
        "VBE": ("verb", {}), "PN": ("pronoun", {}), "PN_ADJ": ("pronoun_adjective", {}), "NUMERAL": ("numeral", {}),
        "PRON": ("pronoun_noun", {}), "CONJ": ("conjunction", {}), "INT": ("interjection", {}), "PREP": ("preposition", {}),
        "PART": ("particle", {}), "ARTICLE": ("article", {}), "ORDNUM": ("numeral_ordinal", {}), "POSS": ("possessive", {}),
    },
    main_codes=frozenset("aa ad ba va ta pa da ea na fa oa ga xa xb xc xd xf xi xp yc yd xx".split()),
)

LANGUAGES = {"ru": RUSSIAN, "en": ENGLISH}


def pack(language: Language, part: str, **fields: int) -> int:
    """The packed value of a part of speech."""
    out, at = language.tags.index(part), 5
    for name, bits in language.layouts.get(part, ()):
        out |= (fields.get(name, 0) & ((1 << bits) - 1)) << at
        at += bits
    return out


def _bits(attr: Column, at: int, bits: int) -> Column:
    return F.shiftright(attr, at).bitwiseAND((1 << bits) - 1)


def tag(attr: Column, language: Language) -> Column:
    """The name of the part of speech."""
    names = F.array(*[F.lit(t) for t in language.tags])
    return F.coalesce(F.get(names, attr.bitwiseAND(31)), F.lit("unknown"))


def decode(attr: Column, language: Language) -> Column:
    """A struct of the tag and every field; a field that the part lacks is null."""
    names = sorted({n for layout in language.layouts.values() for n, _ in layout})
    columns = []
    for name in names:
        value = F.when(F.lit(False), F.lit(0))
        for part, layout in language.layouts.items():
            at = 5
            for n, bits in layout:
                if n == name:
                    value = value.when(attr.bitwiseAND(31) == language.tags.index(part), _bits(attr, at, bits))
                at += bits
        columns.append(value.alias(name))
    return F.struct(tag(attr, language).alias("tag"), *columns)


def describe(attr: Column, language: Language) -> Column:
    """The description: title and the texts of the fields that have one, joined by commas.

    A field whose zero has no text is left out when zero; of several bits the lowest with a text is told.
    """
    out = F.when(F.lit(False), F.lit(""))
    for part, title in zip(language.tags, language.titles, strict=True):
        pieces, at, place = [], 5, {}
        for n, bits in language.layouts.get(part, ()):
            place[n] = (at, bits)
            at += bits
        for name in language.shown.get(part, ()):
            value = _bits(attr, *place[name])
            texts = language.values.get(f"{name}@{part}", language.values[name])
            flags = all(v & (v - 1) == 0 for v in texts)
            text = F.when(F.lit(False), F.lit(""))
            for v, t in texts.items():
                text = text.when(value == v, F.lit(t))
            if flags:
                for v, t in texts.items():
                    if v:
                        text = text.when(value.bitwiseAND(v) != 0, F.lit(t))
            pieces.append(text)
        out = out.when(attr.bitwiseAND(31) == language.tags.index(part), F.concat_ws(", ", F.lit(title), *pieces))
    return F.coalesce(out, F.lit(language.titles[0]))


def parse_tab_line(line: str, language: Language) -> tuple[str, int]:
    """(code, packed attributes) of a line `code type part attributes`; an unknown part packs to 0."""
    fields = line.split(" ")
    if len(fields) < 3:
        raise ValueError(f"a tab line needs three fields: {line!r}")
    part, forced = language.types.get(fields[2], ("unknown", {}))
    if part == "unknown":
        return fields[0], 0
    names = fields[3].split(",") if len(fields) > 3 else []
    found: dict[str, int] = {}
    for name in names:
        if name in language.words:
            key, how, value = language.words[name]
            found[key] = found.get(key, 0) | value if how == "or" else value
    if language is RUSSIAN and "2" in names and found.get("case") in (2, 7):
        found["case"] += 1  # the second genitive and prepositional
    return fields[0], pack(language, part, **(found | forced))
