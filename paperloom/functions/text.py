"""Text analysis as column expressions."""

from pyspark.sql import Column, functions as F

from paperloom import constants as C
from paperloom.functions.truth import first_text, text_or_null

_WORD = rf"(?U)[^{C.SPACE}]+"


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(C.SPACES))


def words(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(_WORD), F.lit(0))


def word_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(_WORD))


def estimate_tokens(count: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(count * C.TOKENS_PER_WORD)).cast("int")


def lines(col: Column) -> Column:
    """Non-blank lines without surrounding space."""
    stripped = F.transform(F.split(col, C.LINE_END, -1), strip)
    return F.filter(stripped, lambda line: line != "")


def _matching(line_list: Column, pattern: str) -> Column:
    return F.size(F.filter(line_list, lambda line: line.rlike(pattern)))


def struct_type(text: Column, n_words: Column, line_list: Column) -> Column:
    """short, code, list, structured or prose, tested in that order."""
    total = F.size(line_list)
    code = (total > 0) & (_matching(line_list, C.CODE_LINE) / total >= C.CODE_SHARE)
    bullets = (total > 0) & (_matching(line_list, C.BULLET_LINE) / total >= C.BULLET_SHARE)
    return (
        F.when(n_words < C.SHORT_DOC_WORDS, "short")
        .when(text.contains(C.FENCE) | code, "code")
        .when(bullets, "list")
        .when(_matching(line_list, C.HEADING_LINE) >= C.MIN_HEADINGS, "structured")
        .otherwise("prose")
    )


def title(text: Column, line_list: Column, kind: Column, given: Column | None = None) -> Column:
    """Given title, else one read off the first line or the first sentence."""
    first = F.get(line_list, F.lit(0))
    sentence = words(F.substring_index(text, ".", 1))
    opening = F.array_join(F.slice(sentence, 1, C.TITLE_WORDS), " ")
    caps = (first == F.upper(first)) & (first != F.lower(first))
    found = (
        F.when((kind == "short") | (F.size(line_list) == 0), F.lit(None))
        .when(first.startswith("#"), strip(F.regexp_replace(first, "^#+", "")))
        .when(caps & (F.length(first) < C.CAPS_TITLE_LENGTH), first)
        .when(
            (F.length(first) < C.COLON_TITLE_LENGTH) & first.endswith(":"),
            strip(F.regexp_replace(first, ":+$", "")),
        )
        .when(F.size(sentence) > 0, opening)
    )
    return found if given is None else F.coalesce(given, found)


def slugify(col: Column) -> Column:
    """Kebab-case folder name of at most 60 characters."""
    kept = F.regexp_replace(strip(F.lower(col)), rf"(?U)[^\w{C.SPACE}-]", "")
    dashed = F.regexp_replace(kept, rf"(?U)[{C.SPACE}_]+", "-")
    short = F.substring(F.regexp_replace(dashed, "-{2,}", "-"), 1, C.SLUG_LENGTH)
    return F.regexp_replace(short, "^-+|-+$", "")


def doc_path(
    base: Column, group: Column, doc_type: Column, source: Column, doc_id: Column,
    existing: Column | None = None,
) -> Column:
    """``base/group/type/source/id.md``; an existing path is kept."""
    name = F.when(F.lower(doc_id).endswith(".md"), doc_id).otherwise(F.concat(doc_id, F.lit(".md")))
    built = F.concat_ws(
        "/", base, group,
        first_text(doc_type, F.lit(C.DEFAULT_TYPE)),
        first_text(source, F.lit(C.UNKNOWN_DOC_SOURCE)),
        name,
    )
    return built if existing is None else first_text(existing, built)


def new_group_name(
    agent_name: Column, project: Column, title_col: Column, doc_id: Column
) -> Column:
    """Slug of the first usable name; blank agent and project names are skipped."""
    def unless_blank(col: Column) -> Column:
        return F.when(strip(col) != "", col)

    return slugify(
        F.coalesce(
            unless_blank(agent_name), unless_blank(project),
            first_text(title_col, doc_id, F.lit(C.NEW_GROUP)),
        )
    )


def new_group_description(agent_text: Column, title_col: Column) -> Column:
    generic = F.format_string(
        C.GROUP_DESCRIPTION, F.coalesce(title_col, F.lit(C.UNKNOWN_PROJECT))
    )
    return F.coalesce(text_or_null(strip(agent_text)), generic)


def assigned_group_name(target: Column, candidates: Column) -> Column:
    """Name of the target among the candidate structs (id, name), else the id itself."""
    named = F.filter(
        candidates, lambda c: (c["id"] == target) & text_or_null(c["name"]).isNotNull()
    )
    return F.when(
        text_or_null(target).isNotNull(), F.coalesce(F.get(named, F.lit(0))["name"], target)
    )
