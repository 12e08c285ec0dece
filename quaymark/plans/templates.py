"""Task shapes by name, and which task has which.

Shapes are put together from parts; descriptors and defaults are parameters. A part is ``shared`` if its separator and
casing are those of the whole template.
"""

from __future__ import annotations

import re

from quaymark.plans.grammar import Bare, Field, Items, Node, Owner, Spaced, Template

_SHARED = {"separator_of": "separator", "casing_of": "casing"}


def _field(name: str, **more) -> Field:
    return Field(re.sub(r"\W+", "_", name.lower()), name, **(_SHARED | more))


def _answer(name: str = "Answer") -> Field:
    return Field("output", name, output=True, **_SHARED)


def _items(name: str, descriptor: str, items: int | tuple[int, ...], **more) -> Items:
    """An enumeration; one with a descriptor has the template's casing, unless told otherwise."""
    places = tuple(range(items)) if isinstance(items, int) else items
    return Items(name, descriptor, places, **(({"casing_of": "casing", "separator": ": ", "wrapper": "{}"} if descriptor else {}) | more))


def _block(heading: str | None, items: Items, space: str = " ", only_blank: bool = False, field: str | None = None) -> Spaced:
    """Items under a heading, or after a field."""
    head: tuple[Node, ...] = (_field(heading, with_text=False),) if heading else (_field(field),) if field else ()
    return Spaced("block", (*head, items), "" if only_blank else space, only_blank)


def _template(name: str, *parts: Node, space: str = "\n", separator: str = ": ", casing: str = "identity", classes: str | None = None, searched: tuple[str, ...] | None = None, lengths: tuple[int, ...] = ()) -> Template:
    return Template(name, Spaced("all", parts, space), (Owner("separator", "separator", separator), Owner("casing", "casing", casing)), searched, classes, lengths)


def fields(*names: str, output: str = "Answer", space: str = "\n", separator: str = ": ", casing: str = "identity", name: str | None = None) -> Template:
    """Fields with one separator and one casing for all: 16 x 15 x 4 formats however many fields."""
    return _template(name or "_".join(n.lower().replace(" ", "_") for n in names), *map(_field, names), _answer(output), space=space, separator=separator, casing=casing)


def field_bare(descriptor: str, space: str = "\n", name: str = "field_bare") -> Template:
    """A field, bare text, and the answer."""
    return _template(name, _field(descriptor), Bare("rest"), _answer(), space=space)


def choices(*before: str, options: int, space: str = "\n", between: str = " ", blank: bool = True, name: str = "choices", **how) -> Template:
    """Fields, then options under a heading, one of which is the answer."""
    block = _block("Options", _items("options", "", options, separator=" ", space=between, **how), only_blank=blank)
    return _template(name, *map(_field, before), block, _answer(), space=space, classes="{enum1}")


_LETTERS = {"numbering": "upper_letter"}
_BARE_LETTERS = {"separator": " ", "space": " ", "gap": "", **_LETTERS}

CATALOGUE: dict[str, Template] = {
    t.name: t
    for t in (
        fields("Sentence", name="one_field"),
        fields("Input", output="Output", name="input_output"),
        fields("Passage", "Question", name="two_fields"),
        fields("Claim", "Post", space=". ", separator=" : ", casing="upper", name="two_fields_upper"),
        fields("Sentence", "Reason", "Question", space="\n ", name="three_fields"),
        field_bare("Target", " \n"),
        _template("sentence_pair", _items("pair", "Sentence", 2), _answer(), space=" \n "),
        _template("sentence_pair_lettered", _items("pair", "sentence", 2, gap="_", **_LETTERS), _answer(), space=" \n "),
        _template(
            "story_titles",
            _items("sentences", "Sentence", 5, separator_of="separator"),
            _block("Choices", _items("choices", "", 2, wrapper="{}.", numbering="lower_letter"), only_blank=True),
            _answer(), space=" ", classes="{enum1}", searched=(),
        ),
        _template("question_options_5", _field("Question"), _block("Options", _items("options", "", 5, wrapper="<{}>")), _answer(), space="\n ", classes="{enum1}"),
        choices("Article", "Question", options=4, space="\n ", name="article_question_options_4", **_LETTERS),
        _template("sentence_question_2", _field("Sentence"), _field("Question"), _items("answers", "", 2, **_LETTERS), _answer(), space=" ", classes="{enum1}"),
        Template(
            "text_options_4",
            Spaced("all", (Field("text", "", ""), Items("options", "", (0, 1, 2, 3), " ", "", "({})", "upper_letter"), Field("output", "Answer", ": ", output=True)), "\n"),
            (), None, "{enum1}",
        ),
        _template(
            "passage_facts_variable",
            _block("Passage", _items("facts", "Fact", 15, separator="- "), only_blank=True),
            _field("Question"), _field("Answer"), _answer("Final Output"), space=" ", classes="{enum1}", lengths=tuple(range(2, 16)),
        ),
        _template(
            "facts_question_options_8",
            _items("facts", "Fact", 2, gap="", space=", "), _block(None, _items("options", "", 8, **_LETTERS), field="Question"), _answer(), space=", ", classes="{enum1}",
        ),
        _template(
            "story_gap",
            _items("sentences", "Sentence", (0, 2, 3, 4), space=" \n "), _items("options", "Option", 2, space=" \n "), _answer(), space=" \n ", classes="Option {enum1}",
        ),
        _template("beginning_middle_ending", _field("Beginning"), _items("middle", "Middle", 2), _field("Ending"), _answer(), space=" ", classes="{enum1}"),
        _template("prompt_completions", _field("Prompt"), _items("completions", "Completion", 2, space=" \n", **_LETTERS), _answer(), space=" \n", classes="Completion {enum1}"),
        _template(
            "sentences_variable_options",
            _items("sentences", "Sentence", 10, gap=""), _block(None, _items("options", "", 2, **_LETTERS)), _answer(), space=" \n ", classes="{enum1}", lengths=tuple(range(1, 11)),
        ),
        _template("bare_options_5", Bare("text"), _items("options", "", 5, separator="", gap="", **_LETTERS), _answer(), classes="{enum1}"),
        _template("question_options_5_blank", _field("Question"), _block("Options", _items("options", "", 5, wrapper="{}", **_BARE_LETTERS), only_blank=True), _answer(), space=" \n ", classes="{enum1}"),
        _template("context_question_options_3", _field("Context"), _field("Question"), _block("Options", _items("options", "", 3, **_BARE_LETTERS), only_blank=True), _answer(), space=" \n ", classes="{enum1}"),
        _template(
            "title_sentences_choices",
            _field("Title"), _items("sentences", "Sentence", 4, separator_of="separator", casing_of=None, gap=" "),
            _block("Choices", _items("choices", "", 2, separator=". ", wrapper="{}", gap="", numbering="lower_letter"), only_blank=True),
            _answer(), space=" ", classes="{enum1}",
        ),
    )
}

#: The tasks of each shape with their own descriptors, spaces and signs.
_SHAPES: tuple[tuple[tuple[int, ...], Template], ...] = (
    ((1661, 27), CATALOGUE["two_fields"]),
    ((136, 21, 18, 20, 740), fields("Sentence", "Question")),
    ((1366,), fields("Paragraph", "Claim")),
    ((1162,), fields("Paragraph", "Title", space="\n ")),
    ((1587,), fields("Abstract", "Title", space=". ")),
    ((491, 492), fields("Sentence", "Question", space=" ")),
    ((50,), fields("Sentence", "Question", space=" \n")),
    ((1387,), fields("Premise", "Hypothesis", space=" <sep> ")),
    ((1186, 1283, 1284), fields("System Reference", "Original Reference")),
    ((905,), fields("Tweet", "Label")),
    ((903,), fields("Review", "Polarity")),
    ((501,), CATALOGUE["two_fields_upper"]),
    ((155, 158, 161, 162, 163, 113, 114), CATALOGUE["one_field"]),
    ((322, 323, 324, 325, 326, 327, 328), fields("Comment")),
    ((333, 335, 337), fields("Post")),
    ((277, 278), fields("Context")),
    ((279, 280, 316, 317), fields("Passage")),
    ((318, 319, 320, 321), CATALOGUE["field_bare"]),
    ((133,), CATALOGUE["three_fields"]),
    ((190, 1347), CATALOGUE["sentence_pair"]),
    ((1612,), CATALOGUE["sentence_pair_lettered"]),
    ((220,), CATALOGUE["story_titles"]),
    ((1431,), CATALOGUE["question_options_5"]),
    ((309,), CATALOGUE["article_question_options_4"]),
    ((1380, 1381), CATALOGUE["sentence_question_2"]),
    ((697, 729), CATALOGUE["text_options_4"]),
    ((84,), CATALOGUE["passage_facts_variable"]),
    ((1297,), CATALOGUE["facts_question_options_8"]),
    ((65,), CATALOGUE["story_gap"]),
    ((69, 70), CATALOGUE["beginning_middle_ending"]),
    ((137, 138, 139, 140), CATALOGUE["prompt_completions"]),
    ((296, 297), CATALOGUE["sentences_variable_options"]),
    ((118,), CATALOGUE["bare_options_5"]),
    ((1135,), CATALOGUE["question_options_5_blank"]),
    ((1419, 1420, 1421, 1422, 1423, 1424), choices("Problem", options=5, space=" \n", between=" , ", wrapper="{} )", numbering="lower_letter", gap="", name="problem_options_5_round")),
    ((1678,), choices("Problem", options=5, between=", ", wrapper="{}.", numbering="lower_letter", name="problem_options_5_dotted")),
    ((385, 580), CATALOGUE["context_question_options_3"]),
    ((213, 214), CATALOGUE["title_sentences_choices"]),
)
TASKS: dict[int, Template] = {number: t for numbers, t in _SHAPES for number in numbers}

#: Tasks whose inputs have no fields, and tasks whose answers are open texts.
UNFORMATTED = frozenset((1502, 1503, 1504, 1664, 1669, 1670, 1720, 1725, 904, 108, 1604, 1605, 1606, 1607, 1721, 1722, 1723, 1724, 607, 608, 609, 286, 1149, 1189))
OPEN = frozenset((240, 845, 348, 389, 443, 223, 105, 1401, 40, 67, 71, 72, 1326, 37, 38, 1613, 216))

OPEN_NAMES = frozenset(f"task{n:03d}_" for n in OPEN)


def number_of(task: str) -> int:
    """The number in a task file's name ('task065_x.json'); -1 without one."""
    found = re.match(r".*?task(\d+)_", task)
    return int(found[1]) if found else -1


def template_of(task: str, unformatted: frozenset[int] = UNFORMATTED) -> Template:
    """The template of a task file's name ('task065_x.json'); input and output for tasks without fields.

    A task that no shape is known for is an error.
    """
    number = number_of(task)
    if number in unformatted:
        return CATALOGUE["input_output"]
    if number not in TASKS:
        raise KeyError(f"no template for {task}")
    return TASKS[number]
