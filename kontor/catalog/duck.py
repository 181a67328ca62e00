"""DuckDB text for the checks: written against the rules, not generated from Spark plans."""

from __future__ import annotations

from kontor.functions import normalize as N
from kontor.functions import scoring as S
from kontor.functions import validate as V
from kontor.plans.demo_view import company_sql


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def squash(x: str) -> str:
    return rf"regexp_replace({strip(x)}, '\s+', ' ', 'g')"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def email(x: str) -> str:
    a = f"regexp_replace(lower({strip(x)}), '^(mailto:|email:)', '')"
    return (
        f"CASE WHEN regexp_matches({a}, {q(V.EMAIL_SYNTAX)}) AND length({a}) <= 254"
        f" AND instr({a}, '@') <= 65 THEN {a} END"
    )


def phone_parts(x: str) -> tuple[str, str]:
    bare = strip(f"regexp_replace({strip(x)}, '(?i)^(tel:|phone:|telefon:)', '')")
    packed = rf"regexp_replace(regexp_replace({bare}, '[ \-/().\t]', '', 'g'), '^00', '+')"
    dialled = rf"(CASE WHEN regexp_matches({packed}, '^\+?[0-9]+$') THEN {packed} END)"
    d = f"ltrim({dialled}, '+')"
    cc = f"(CASE WHEN starts_with({dialled}, '+') THEN regexp_extract({d}, {q(V.CALLING_CODE)}, 1) WHEN {dialled} IS NOT NULL THEN '49' END)"
    nat = (
        f"(CASE WHEN starts_with({dialled}, '+') THEN regexp_replace(substr({d}, length({cc}) + 1), '^0', '')"
        f" ELSE regexp_replace({d}, '^0', '') END)"
    )
    return cc, nat


def phone(x: str) -> str:
    cc, nat = phone_parts(x)
    head = (
        f"(CASE WHEN regexp_matches({nat}, {q(V.DE_MOBILE)}) THEN regexp_extract({nat}, '^(15[0-9][0-9]|1[67][0-9])', 1)"
        f" ELSE regexp_extract({nat}, {q(V.DE_AREA)}, 1) END)"
    )
    ok = f"(regexp_matches({nat}, {q(V.DE_MOBILE)}) OR regexp_matches({nat}, {q(V.DE_FIXED)}))"
    return (
        f"CASE WHEN {cc} = '49' AND {ok} THEN '+49 ' || {head} || ' ' || substr({nat}, length({head}) + 1)"
        f" WHEN {cc} <> '49' AND {cc} <> '' AND length({cc}) + length({nat}) BETWEEN 8 AND 15 THEN '+' || {cc} || ' ' || {nat} END"
    )


def website(x: str) -> str:
    s = strip(x)
    url = f"(CASE WHEN starts_with({s}, 'http://') OR starts_with({s}, 'https://') THEN {s} ELSE 'https://' || {s} END)"
    shape = q(r"^(https?)://([^/?#]*)([^?#]*)")
    host = f"lower(regexp_extract({url}, {shape}, 2))"
    path = f"regexp_replace(regexp_replace(regexp_extract({url}, {shape}, 3), ';[^/]*$', ''), '/+$', '')"
    return (
        f"CASE WHEN {x} <> '' AND {host} <> '' AND contains({host}, '[') = contains({host}, ']')"
        f" THEN regexp_extract({url}, {shape}, 1) || '://' || {host} || {path} END"
    )


def postal_code(x: str) -> str:
    return f"CASE WHEN length({digits(x)}) = 5 THEN {digits(x)} ELSE nullif({strip(x)}, '') END"


def company_name(x: str) -> str:
    return f"CASE WHEN length({squash(x)}) >= 2 THEN {squash(x)} END"


def norm_name(x: str) -> str:
    word = (
        "CASE WHEN (w = upper(w) AND w <> lower(w) AND length(w) > 1) OR substr(w, 2) <> lower(substr(w, 2)) THEN w"
        " ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END"
    )
    return f"array_to_string(list_transform(string_split({squash(x)}, ' '), lambda w: {word}), ' ')"


def title(x: str) -> str:
    runs = rf"regexp_extract_all({x}, '\p{{L}}+|[^\p{{L}}]+')"
    return (
        f"array_to_string(list_transform({runs}, lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '')"
    )


def norm_legal_form(x: str) -> str:
    form = rf"regexp_replace(lower({strip(x)}), '(^rechtsform:?\s*|\s*\(.*\)$)', '', 'g')"
    arms = " ".join(f"WHEN contains({form}, '{k}') THEN '{v}'" for k, v in N.LEGAL_FORMS.items())
    return f"CASE WHEN {x} <> '' THEN CASE {arms} ELSE upper({form}) END END"


def norm_state(x: str) -> str:
    s = f"lower({strip(x)})"
    arms = " ".join(
        f"WHEN {s} IN ({q(code)}, {q(name.lower())}" + (", 'baden württemberg'" if code == "bw" else "") + f") THEN {q(name)}"
        for code, name in N.STATE_CODES.items()
    )
    return f"CASE WHEN {x} <> '' THEN CASE {arms} ELSE {title(s)} END END"


def norm_city(x: str) -> str:
    return f"CASE WHEN {x} <> '' THEN {title(squash(x))} END"


def norm_list(text: str) -> str:
    """List from '|'-separated text, cleaned, as '|'-joined text or NULL."""
    items = f"list_transform(list_filter(string_split({text}, '|'), lambda v: v <> ''), lambda v: {strip('v')})"
    low = f"list_transform({items}, lambda v: lower(v))"
    kept = f"list_filter({items}, lambda v, i: list_position({low}, lower(v)) = i)"
    return f"CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, '|') END"


def form_ending(x: str) -> str:
    return (
        f"(CASE WHEN regexp_extract({x}, {q(N.FORM_SUFFIX)}) <> '' THEN regexp_extract({x}, {q(N.FORM_SUFFIX)})"
        f" ELSE regexp_extract({x}, {q(N.FORM_PARENS)}) END)"
    )


def form_name(x: str) -> str:
    e = form_ending(x)
    return f"(CASE WHEN {e} <> '' THEN {strip(f'substr({x}, 1, length({x}) - length({e}))')} ELSE {x} END)"


def clip(x: str, limit: int = 1000) -> str:
    s = strip(x)
    return f"CASE WHEN length({s}) > {limit} THEN substr({s}, 1, {limit - 3}) || '...' ELSE {s} END"


def address(street: str, plz: str, city: str) -> str:
    place = strip(f"concat_ws(' ', nullif({plz}, ''), nullif({city}, ''))")
    return f"nullif(concat_ws(', ', nullif({street}, ''), nullif({place}, '')), '')"


def domain(x: str) -> str:
    host = f"lower(regexp_extract({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"
    return f"CASE WHEN {host} <> '' THEN {host} ELSE {x} END"


def token_key(x: str) -> str:
    plain = rf"regexp_replace(lower({x}), '[\x{{80}}-\x{{ff}}]', '', 'g')"
    words = strip(rf"lower(regexp_replace({plain}, '[^a-z0-9_]', ' ', 'g'))"
    )
    return rf"array_to_string(list_sort(list_filter(regexp_split_to_array({words}, '\s+'), lambda w: w <> '')), ' ')"


def lcs(a: str, b: str) -> str:
    """LCS length by row-wise dynamic programming: ``prev`` is a finished row, ``cur`` grows."""
    cell = (
        f"CASE WHEN substr({a}, j, 1) = substr({b}, i, 1) THEN prev[j] + 1"
        " ELSE greatest(prev[j + 1], cur[j]) END"
    )
    row = f"list_reduce(range(1, length({a}) + 1), lambda cur, j: list_append(cur, {cell}), [0::BIGINT])"
    zeros = f"list_transform(range(0, length({a}) + 1), lambda z: 0::BIGINT)"
    return f"list_last(list_reduce(range(1, length({b}) + 1), lambda prev, i: {row}, {zeros}))"


def ratio(a: str, b: str) -> str:
    share = f"(2.0::DOUBLE * {lcs(a, b)}) / (length({a}) + length({b}))"
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0 WHEN {a} = {b} THEN 100"
        f" ELSE CAST(round_even(100.0::DOUBLE * ({share}), 0) AS INT) END"
    )


CO = company_sql()

# The stored form of the demo companies: what the cleansing step leaves.
STORED = f"""
SELECT id, g,
  {company_name('company_name')} AS company_name,
  {norm_legal_form(f"(CASE WHEN coalesce(lf, '') = '' THEN {strip(form_ending('vname'))} ELSE lf END)")} AS legal_form,
  CASE WHEN industry <> '' THEN {strip('industry')} ELSE industry END AS industry,
  {clip('description')} AS description,
  {website('website')} AS website,
  {email('email')} AS email,
  {phone('phone')} AS phone,
  street,
  CASE WHEN address <> '' THEN {strip('address')} ELSE address END AS address,
  {postal_code('postal_code')} AS postal_code,
  {norm_city('city')} AS city,
  {norm_state('state')} AS state,
  team_size,
  {norm_list('directors_text')} AS directors_text,
  {norm_list('technologies_text')} AS technologies_text,
  lead_status, lead_quality, lead_score, is_active
FROM (SELECT *, {strip('legal_form')} AS lf, {company_name('company_name')} AS vname FROM ({CO})) r
WHERE vname IS NOT NULL
"""


def _in_list(items: list[str], probe: str) -> str:
    return " OR ".join(probe.format(q(i)) for i in items)


def score_sql(rel: str) -> str:
    """Score of company rows with '|'-joined directors_text and technologies_text."""
    addr = address("street", "postal_code", "city")
    site = f"{strip('lower(website)')}"
    ind = f"{strip('lower(industry)')}"
    modern = _in_list(S.MODERN_KEYWORDS, "contains(lower(t), {})")
    techs = "string_split(technologies_text, '|')"
    social = _in_list(S.SOCIAL_SITES, f"contains({site}, {{}})")
    words = rf"regexp_split_to_array({ind}, '\s+')"
    valued = "[" + ", ".join(q(w) for w in S.VALUED_INDUSTRIES) + "]"
    filled = " + ".join(
        [f"CAST(coalesce({c} <> '' AND {c} <> 'null', false) AS INT)" for c in ("company_name", "email", "phone", "website", "city", "industry")]
        + [f"CAST({addr} IS NOT NULL AS INT)", "CAST(coalesce(team_size <> 0, false) AS INT)"]
        + ["CAST(technologies_text IS NOT NULL AS INT)", "CAST(directors_text IS NOT NULL AS INT)"]
    )
    return f"""
SELECT *, contact_pts + website_pts + industry_pts + size_pts + tech_pts + quality_pts AS score,
  CASE WHEN contact_pts + website_pts + industry_pts + size_pts + tech_pts + quality_pts >= 80 THEN 'hot'
       WHEN contact_pts + website_pts + industry_pts + size_pts + tech_pts + quality_pts >= 60 THEN 'warm'
       WHEN contact_pts + website_pts + industry_pts + size_pts + tech_pts + quality_pts >= 40 THEN 'cold'
       ELSE 'low_quality' END AS quality
FROM (SELECT *,
  CAST(CASE WHEN coalesce(email, '') = '' THEN 0 WHEN regexp_matches(email, {q(V.LOOSE_EMAIL)}) THEN 10 ELSE 5 END
    + CASE WHEN coalesce(phone, '') = '' THEN 0 WHEN length({digits('phone')}) >= 6 THEN 10 ELSE 5 END
    + CASE WHEN {addr} IS NOT NULL THEN 5 ELSE 0 END
    + CASE WHEN directors_text IS NOT NULL THEN 5 ELSE 0 END AS INT) AS contact_pts,
  CAST(CASE WHEN coalesce({site}, '') = '' THEN 0 ELSE 10 + CASE WHEN starts_with({site}, 'https://') THEN 5 ELSE 0 END
    + CASE WHEN {social} THEN 0 ELSE 5 END END AS INT) AS website_pts,
  CAST(CASE WHEN coalesce({ind}, '') = '' THEN 0 WHEN list_has_any({words}, {valued}) THEN 15 ELSE 5 END AS INT) AS industry_pts,
  CAST(CASE WHEN coalesce(team_size, 0) = 0 THEN 5 WHEN team_size >= 100 THEN 15 WHEN team_size >= 50 THEN 12
    WHEN team_size >= 10 THEN 10 ELSE 7 END AS INT) AS size_pts,
  CAST(CASE WHEN technologies_text IS NULL THEN 0
    ELSE 5 + least(5, 2 * len(list_filter({techs}, lambda t: {modern}))) END AS INT) AS tech_pts,
  CAST(greatest(0, 10 - CASE WHEN coalesce(length(company_name), 0) < 3 THEN 5 ELSE 0 END
    - CASE WHEN {filled} < 3 THEN 2 ELSE 0 END) AS INT) AS quality_pts
FROM ({rel}) s) p
"""
