"""Country policies and the custom entity pack as data.

A pattern is put together from small parts, so that each says what it looks for:
``digits(3, 2, 4)`` is groups of so many digits with at most one separator between.
Patterns are matched without regard to case and with ``FLAGS``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Ignore case, anchors at lines, only \n ends a line, Unicode classes and case.
FLAGS = "(?imduU)"
B = r"\b"
#: Words of an address or suburb name at most: Java's matcher recurses once a word.
MOST_WORDS = 20
SEP = r"[\s-]?"
WORD = r"[A-Z][a-z]+"


class Keyed(str):
    """A pattern that no text matches without one of ``keys`` (in upper case) in it, nor without a match of ``need``."""

    keys: tuple[str, ...] = ()
    need: str = ""


def needing(pattern: str, need: str) -> Keyed:
    """``need``: a part that every match has in it, and that is looked for with far less steps."""
    out = Keyed(pattern)
    out.need = need
    return out


def keyed(pattern: str, *words: str) -> Keyed:
    """The keys are what the words begin with, up to the first sign that is no plain letter, blank or colon."""
    out = Keyed(pattern)
    out.keys = tuple(re.match(r"[A-Za-z :/.-]*", w)[0].upper() for w in words)
    if not all(out.keys):
        out.keys = ()
    return out


def edge(body: str) -> str:
    return f"{B}(?:{body}){B}"


def digits(*sizes: int, sep: str = SEP) -> str:
    return B + sep.join(rf"\d{{{n}}}" for n in sizes) + B


def run(low: int, high: int | None = None, of: str = r"\d") -> str:
    return f"{of}{{{low}}}" if high is None else f"{of}{{{low},{high}}}"


def any_of(words: str) -> str:
    """Alternatives given as words parted by blanks, tried by first letter; ``_`` stands for white space within one."""
    by: dict[str, list[str]] = {}
    for w in words.split():
        by.setdefault(w[0], []).append(w[1:].replace("_", r"\s+"))
    return "(?:" + "|".join(k + (f"(?:{'|'.join(v)})" if len(v) > 1 else v[0]) for k, v in by.items()) + ")"


def after(keys: str, value: str, number: str = "") -> str:
    """A keyword, perhaps a word for number, perhaps a colon, and a value. ``keys`` by ``/``."""
    middle = rf"\s*(?:{number}|#)?" if number else ""
    return keyed(rf"{B}(?:{'|'.join(keys.split('/'))}){middle}\s*:?\s*{value}{B}", *keys.split("/"))


ALNUM = "[A-Z0-9]"
DAY, MONTH, YEAR = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)\d{2}"
SOFT_DAY, SOFT_MONTH = r"(?:0?[1-9]|[12]\d|3[01])", r"(?:0?[1-9]|1[0-2])"
ISO_DATE = edge("-".join((YEAR, MONTH, DAY)))
MAIL = r"[\w.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}".replace(r"\w", "A-Za-z0-9_")
CARD = digits(4, 4, 4, 4)
QUAD = B + r"\.".join([run(1, 3)] * 4) + B
_UNSAFE = r"""[^\s<>"{}|\\^`\[\]]+"""
LINK = keyed(rf"https?://{_UNSAFE}|www\.{_UNSAFE}\.[a-z]{{2,}}", "http", "www.")
NANP = rf"{B}(?:\+?1[-.\s]?)?\(?\d{{3}}\)?[-.\s]?\d{{3}}[-.\s]?\d{{4}}{B}"
UK_CODE = rf"{B}[A-Z]{{1,2}}[0-9R]{ALNUM}?\s?\d[A-Z]{{2}}{B}"
NINO = rf"{B}[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\d{{6}}[A-D]{B}"
CHASSIS = rf"{B}[A-HJ-NPR-Z0-9]{{17}}{B}"


def phone(prefix: str, low: int, high: int | None = None) -> str:
    return rf"{B}(?:{prefix})(?:\d\s?){{{low}{'' if high is None else f',{high}'}}}{B}"


def street(suffixes: str) -> str:
    return rf"{B}\d+\s+(?:{WORD}\s+){{1,{MOST_WORDS}}}{any_of(suffixes)}{B}"


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    action: str | None = None
    threshold: float | None = None


@dataclass(frozen=True)
class Policy:
    country: str
    rules: tuple[Rule, ...]
    default: str
    actions: dict[str, str] = field(default_factory=dict)

    def action(self, label: str) -> str:
        return self.actions.get(label, self.default)


def _policy(country: str, default: str, rules: list[tuple], **more: str) -> Policy:
    made = tuple(Rule(*r) for r in rules)
    return Policy(country, made, default, {r.label: r.action for r in made if r.action} | more)


_EIGHT, _NINE, _TEN, _FIVE = (digits(n) for n in (8, 9, 10, 5))

AU = _policy("AU", "mask", [
    ("PERSON_NAME", edge(rf"{WORD}\s{WORD}"), "replace"),
    ("TFN", digits(3, 3, 3), "replace"),
    ("ABN", digits(2, 3, 3, 3), "replace"),
    ("ACN", digits(3, 3, 3)),
    ("MEDICARE", edge(SEP.join((run(4), run(5), "[1-9]", r"\d"))), "replace"),
    ("IHI", edge("800360" + run(10)), "replace"),
    ("DVA", edge("[NQVWST][A-Z]" + run(6) + "[A-Z]?")),
    ("PBS_CARD", _TEN),
    ("DRIVER_LICENSE_NSW", _EIGHT),
    ("DRIVER_LICENSE_VIC", edge(run(7, 10))),
    ("DRIVER_LICENSE_QLD", _NINE),
    ("DRIVER_LICENSE_SA", edge("[A-Z]" + run(6))),
    ("DRIVER_LICENSE_WA", digits(7)),
    ("DRIVER_LICENSE_TAS", edge(run(7, 8))),
    ("DRIVER_LICENSE_ACT", _EIGHT),
    ("DRIVER_LICENSE_NT", _EIGHT),
    ("PASSPORT_AU", edge(f"[A-Z]{run(7)}|[A-Z]{{2}}{run(6)}")),
    ("BSB", digits(3, 3)),
    ("CREDIT_CARD", CARD),
    ("BANK_ACCOUNT", edge(run(6, 10))),
    ("PHONE_AU", "|".join((B + SEP.join((r"0[23478]\d\d", run(3), run(3))) + B, B + SEP.join((r"\+61", r"\d", run(4), run(4))) + B, B + SEP.join(("1[38]00", run(3), run(3))) + B))),
    ("MOBILE_AU", "|".join((B + SEP.join((r"04\d\d", run(3), run(3))) + B, B + SEP.join((r"\+61", r"4\d\d", run(3), run(3))) + B))),
    ("EMAIL", MAIL, "hash"),
    ("DOB_ISO", ISO_DATE),
    ("DOB_AU", edge("[/-]".join((DAY, MONTH, YEAR)))),
    ("POSTCODE_AU", digits(4)),
    ("ADDRESS_STREET", rf"{B}\d+[A-Za-z]?\s+(?:{WORD}\s){{0,{MOST_WORDS}}}?" + any_of("Ave Avenue Boulevard Bvd Cct Circuit Cl Close Court Cres Crescent Ct Dr Drive Gr Grove Highway Hwy Lane Ln Pl Place Rd Road St Street Tce Terrace Way") + B),
    ("ADDRESS_STATE", edge(any_of("Victoria VIC Tasmania TAS Queensland QLD New_South_Wales NSW Northern_Territory NT Australian_Capital_Territory ACT Western_Australia WA South_Australia SA"))),
    ("SUBURB_AU", needing(rf"{B}{WORD}(?:\s+{WORD}){{0,{MOST_WORDS}}}\s+{any_of('ACT NSW NT QLD SA TAS VIC WA')}\s+\d{{4}}{B}", rf"\s{any_of('ACT NSW NT QLD SA TAS VIC WA')}\s+\d{{4}}{B}")),
    ("EMPLOYEE_ID_AU", edge("(?:STAFF|EMP(?:L(?:OYEE)?)?)" + SEP + run(4, 8))),
    ("STUDENT_ID_AU", edge("STU(?:D(?:ENT)?)?" + SEP + run(6, 10))),
    ("CENTRELINK_CRN", edge(run(9) + "[A-Z]")),
    ("IMMIGRATION_VISA", edge("[A-Z]{3}" + run(9))),
    ("VEHICLE_REGO_NSW", edge(SEP.join(("[A-Z]{2}", run(2), "[A-Z]{2}")))),
    ("VEHICLE_REGO_VIC", edge(SEP.join((r"\d[A-Z]{2}", r"\d[A-Z]{2}")))),
    ("VEHICLE_VIN", CHASSIS),
    ("AU_TITLE", edge(any_of("Dame Dr Hon Justice Miss Mr Mrs Ms Prof Rev Sir")) + r"\.?"),
    ("AU_ORGANIZATION", needing(rf"{B}[A-Z][A-Za-z\s&]+" + any_of("Center Centre Clinic College Co Company Corp Corporation Foundation Group Holdings Hospital Institute Limited Ltd Partnership Proprietary Pty Trust University") + rf"\.?{B}", any_of("Center Centre Clinic College Co Company Corp Corporation Foundation Group Holdings Hospital Institute Limited Ltd Partnership Proprietary Pty Trust University") + rf"\.?{B}")),
])

US = _policy("US", "hash", [
    ("SSN", digits(3, 2, 4), "replace", 0.95),
    ("ITIN", edge(SEP.join((r"9\d\d", r"[7-9]\d", run(4)))), "replace"),
    ("EIN", digits(2, 7), "replace"),
    ("DRIVERS_LICENSE", edge(f"[A-Z]{{1,2}}{run(7, 8)}|{run(8, 9)}"), "replace"),
    ("PHONE_US", NANP, "preserve_format", 0.85),
    ("CREDIT_CARD", CARD, "mask", 0.95),
    ("EMAIL", MAIL, "preserve_format", 0.9),
    ("DOB_US", edge("/".join((SOFT_MONTH, SOFT_DAY, YEAR))), "synthetic"),
    ("DOB_ISO", ISO_DATE, "synthetic"),
    ("MEDICAL_RECORD", after("MRN/Chart/Medical Record", run(6, 12, ALNUM)), "replace", 0.9),
    ("MEDICARE_US", edge(SEP.join((run(3), run(2), run(4), "[A-Z]{1,2}"))), "replace"),
    ("MEDICAID", after("medicaid(?: id)?", run(8, 12, ALNUM)), "replace"),
    ("HEALTH_PLAN_ID", after("member id/plan id/health plan", run(6, 15, ALNUM)), "replace"),
    ("DEA_NUMBER", edge("[A-Z]{2}" + run(7)), "replace", 0.95),
    ("NPI", edge(rf"(?:NPI\s*:?\s*)?{run(10)}"), "replace", 0.95),
    ("BANK_ACCOUNT", after("acct/account", run(8, 17), "number"), "encrypt"),
    ("ROUTING_NUMBER", after("ABA/routing", run(9), "number"), "replace"),
    ("IP_ADDRESS", QUAD, "mask"),
    ("URL", LINK, "brackets"),
    ("US_ADDRESS", street("Ave Avenue Blvd Boulevard Court Ct Dr Drive Lane Ln Pl Place Rd Road St Street"), "synthetic"),
    ("US_STATE", edge(any_of("Maine Vermont New_Hampshire Massachusetts Rhode_Island Connecticut New_York New_Jersey Pennsylvania Delaware Maryland Virginia West_Virginia North_Carolina South_Carolina Georgia Florida Ohio Michigan Indiana Illinois Wisconsin Kentucky Tennessee Alabama Mississippi Minnesota Iowa Missouri North_Dakota South_Dakota Nebraska Kansas Oklahoma Texas Arkansas Louisiana Montana Idaho Wyoming Colorado New_Mexico Arizona Utah Nevada California Oregon Washington Alaska Hawaii").replace(r"\s+", " ")), "hash"),
    ("ZIP_CODE", edge(rf"\d{{5}}(?:-\d{{4}})?"), "preserve_format"),
    ("PASSPORT", after("passport", run(6, 9, ALNUM), "number"), "replace"),
    ("VIN", CHASSIS, "hash"),
], PERSON_NAME="synthetic")

_NAME3 = edge(rf"{WORD}\s{WORD}(?:\s{WORD})?")

UK = _policy("UK", "hash", [
    ("PERSON_NAME", _NAME3, "synthetic"),
    ("UK_NINO", NINO, "replace", 0.95),
    ("NHS_NUMBER", digits(3, 3, 4, sep=r"\s?"), "replace", 0.95),
    ("PHONE_UK", phone(r"\+44|0", 10), "preserve_format", 0.85),
    ("MOBILE_UK", phone(r"\+44\s?7|07", 9), "preserve_format"),
    ("EMAIL", MAIL, "preserve_format", 0.9),
    ("DOB_UK", edge("[./]".join((SOFT_DAY, SOFT_MONTH, YEAR))), "synthetic"),
    ("DOB_ISO", ISO_DATE, "synthetic"),
    ("UK_POSTCODE", UK_CODE, "preserve_format", 0.9),
    ("UK_SORT_CODE", digits(2, 2, 2), "replace", 0.95),
    ("UK_ACCOUNT_NUMBER", after("acct/account", run(8), "number"), "encrypt", 0.9),
    ("UK_DRIVING_LICENSE", edge("[A-Z]{5}" + run(6) + "[A-Z]{2}" + run(2)), "replace", 0.9),
    ("UK_PASSPORT", _NINE, "replace"),
    ("UK_REG_PLATE", edge("[A-Z]{2}" + run(2) + r"\s?[A-Z]{3}"), "hash"),
    ("CREDIT_CARD", CARD, "mask", 0.95),
    ("UK_UTR", _TEN, "replace"),
    ("UK_VAT", edge(rf"GB\s?(?:{run(9)}|{run(12)})"), "replace"),
    ("UK_COMPANY_NUMBER", edge(f"{run(8)}|[A-Z]{{2}}{run(6)}"), "hash"),
    ("MEDICAL_RECORD", after("medical record/hospital number/patient id", run(6, 12, ALNUM)), "replace", 0.9),
    ("GP_PRACTICE_CODE", edge("[A-Z]" + run(5)), "replace"),
    ("GMC_NUMBER", after("GMC", run(7)), "replace", 0.95),
    ("NMC_PIN", after("NMC", run(2) + "[A-Z]" + run(4) + "[A-Z]"), "replace", 0.95),
    ("UK_ADDRESS", street("Ave Avenue Cl Close Court Cres Crescent Ct Dr Drive Gardens Gdns Lane Ln Pl Place Rd Road St Street"), "synthetic"),
    ("IP_ADDRESS", QUAD, "mask"),
    ("URL", LINK, "brackets"),
])

EU = _policy("EU", "hash", [
    ("EMAIL", MAIL, "preserve_format", 0.9),
    ("PHONE_EU", r"\+(?:\d\s?){6,14}\d", "preserve_format", 0.85),
    ("PHONE_UK", phone(r"\+44|0", 10), "preserve_format"),
    ("PHONE_DE", phone(r"\+49|0", 10, 11), "preserve_format"),
    ("PHONE_FR", phone(r"\+33|0", 9), "preserve_format"),
    ("DOB_EU", edge("[./]".join((SOFT_DAY, SOFT_MONTH, YEAR))), "synthetic"),
    ("DOB_ISO", ISO_DATE, "synthetic"),
    ("UK_NINO", NINO, "replace", 0.95),
    ("DE_PERSONAL_ID", edge("[A-Z]" + run(8)), "replace"),
    ("FR_INSEE", edge(r"[12]\d\d" + MONTH + DAY + run(7)), "replace"),
    ("IT_FISCAL_CODE", edge("[A-Z]{6}" + run(2) + "[A-Z]" + run(2) + "[A-Z]" + run(3) + "[A-Z]"), "replace"),
    ("ES_DNI", edge(run(8) + "[A-Z]"), "replace"),
    ("ES_NIE", edge("[XYZ]" + run(7) + "[A-Z]"), "replace"),
    ("NL_BSN", edge(run(8, 9)), "replace"),
    ("IBAN", edge("[A-Z]{2}" + run(2) + run(4, None, ALNUM) + run(7) + ALNUM + "{0,16}"), "encrypt", 0.95),
    ("CREDIT_CARD", CARD, "mask", 0.95),
    ("IP_ADDRESS", QUAD, "mask"),
    ("IPV6_ADDRESS", B + ":".join(["[0-9a-f]{1,4}"] * 8) + B, "mask"),
    ("MAC_ADDRESS", B + "[:-]".join(["[0-9a-f]{2}"] * 6) + B, "hash"),
    ("URL", LINK, "brackets"),
    ("EU_ADDRESS", street("Ave Avenue Calle Lane Ln Rd Road Rue St Str Straße Street Via"), "synthetic"),
    ("POSTAL_CODE_UK", UK_CODE, "preserve_format"),
    *((f"POSTAL_CODE_{c}", _FIVE, "preserve_format") for c in ("DE", "FR", "IT", "ES")),
    ("POSTAL_CODE_NL", edge(run(4) + r"\s?[A-Z]{2}"), "preserve_format"),
    ("MEDICAL_RECORD", after("chart number/medical record/patient id", run(6, 12, ALNUM)), "replace", 0.9),
    ("HEALTHCARE_ID", after("professional id/healthcare id", run(6, 15, ALNUM)), "replace"),
    ("EU_LICENSE_PLATE", edge(SEP.join(("[A-Z]{1,3}", run(1, 4), "[A-Z]{1,3}"))), "hash"),
    ("PASSPORT", after("passport", run(6, 9, ALNUM), "number"), "replace"),
    ("DRIVERS_LICENSE", after("driver license/driving licence", run(6, 15, ALNUM), "number"), "replace"),
], PERSON_NAME="synthetic")


def _revenue(kind: str) -> str:
    return edge(rf"{run(9)}\s?{kind}\s?{run(4)}")


CA = _policy("CA", "hash", [
    ("PERSON_NAME", _NAME3, "synthetic"),
    ("CA_SIN", digits(3, 3, 3), "replace", 0.95),
    ("CA_HEALTH_CARD", after("carte santé/health card", run(8, 12, ALNUM)), "replace", 0.9),
    ("ON_OHIP", edge(SEP.join((run(4), run(3), run(3), "[A-Z]{2}"))), "replace", 0.95),
    ("QC_RAMQ", edge("[A-Z]{4}" + run(8)), "replace", 0.95),
    ("BC_PHN", digits(4, 3, 3, sep=r"\s?"), "replace", 0.95),
    ("PHONE_CA", NANP, "preserve_format", 0.85),
    ("EMAIL", MAIL, "preserve_format", 0.9),
    ("DOB_CA", edge("/".join((SOFT_DAY, SOFT_MONTH, YEAR))), "synthetic"),
    ("DOB_ISO", ISO_DATE, "synthetic"),
    ("CA_POSTAL_CODE", edge(r"[A-Z]\d[A-Z]\s?\d[A-Z]\d"), "preserve_format", 0.9),
    ("CA_DRIVERS_LICENSE", edge(f"[A-Z]{{1,2}}{run(7, 8)}|{run(8, 12)}"), "replace", 0.85),
    ("CA_PASSPORT", edge("[A-Z]{2}" + run(6)), "replace", 0.95),
    ("CA_BUSINESS_NUMBER", _revenue("R[TPCM]"), "hash"),
    ("CA_GST_HST", _revenue("RT"), "replace"),
    ("CA_PAYROLL_NUMBER", _revenue("RP"), "replace"),
    ("CA_CORPORATION_NUMBER", _revenue("RC"), "hash"),
    ("CA_BANK_ACCOUNT", after("compte/account", run(7, 12), "numéro|number"), "encrypt"),
    ("CA_TRANSIT_NUMBER", digits(5, 3), "replace"),
    ("CREDIT_CARD", CARD, "mask", 0.95),
    ("MEDICAL_RECORD", after("dossier médical/medical record/patient id", run(6, 12, ALNUM)), "replace", 0.9),
    ("CA_MEDICAL_LICENSE", after("licen[cs]e", run(6, 15, ALNUM), "numéro|number"), "replace"),
    ("CA_ADDRESS", street("Ave Avenue Blvd Boulevard Ch Chemin Dr Drive Lane Ln Rd Road Rue St Street"), "synthetic"),
    ("ON_DRIVERS_LICENSE", edge("[A-Z]" + SEP.join((run(4), run(5), run(5)))), "replace"),
    ("QC_DRIVERS_LICENSE", edge("[A-Z]" + SEP.join((run(4), run(6), run(2)))), "replace"),
    ("AB_PERSONAL_ID", _NINE, "replace"),
    ("IP_ADDRESS", QUAD, "mask"),
    ("URL", LINK, "brackets"),
])

POLICIES = {p.country: p for p in (AU, US, UK, EU, CA)}


def load(country: str, overlay: dict | None = None) -> Policy:
    """A country's policy, with a company's ``regex_patterns`` and ``actions`` laid over it: those win, new labels are appended."""
    base = POLICIES[country.upper()]
    if not overlay:
        return base
    patterns = {r.label: r for r in base.rules}
    for label, pattern in (overlay.get("regex_patterns") or {}).items():
        patterns[label] = Rule(label, pattern, base.actions.get(label))
    actions = base.actions | {k: v for k, v in (overlay.get("actions") or {}).items() if k != "default"}
    return Policy(base.country, tuple(patterns.values()), (overlay.get("actions") or {}).get("default", base.default), actions)


@dataclass(frozen=True)
class PackEntry:
    label: str
    pattern: str
    score: float
    group: int


def _keyed(key: str, value: str, number: str = "") -> str:
    return keyed(rf"{B}({key}){number}\s*:?\s*({value}){B}", *key.split("|"))


def _named(key: str, value: str) -> str:
    return keyed(rf"{B}{key}\s*:?\s*({value}){B}", key)


_NUM = r"\s+(?:number|#)"
_QUOTE = r"""["']?"""
_LETTER_CODE = r"[A-Z]\d{2}(?:\.\d{1,3})?"
_HALF = r"(?:\d{1,3}\.)"


def _armour(kind: str) -> str:
    line = lambda word: rf"-----{word}\s+{kind}PRIVATE\s+KEY-----"
    return keyed(line("BEGIN") + r"[\s\S]*?" + line("END"), "-----BEGIN")


PACK = tuple(PackEntry(*e) for e in (
    ("MEDICAL_RECORD_NUMBER", _named("MRN", run(6, 12, ALNUM)), 0.90, 1),
    ("MEDICAL_RECORD_NUMBER", _keyed(r"medical\s+record|chart", run(6, 12, ALNUM), _NUM), 1.05, 2),
    ("DEA_NUMBER", _named("DEA", "[A-Z]{2}" + run(7)), 0.90, 1),
    ("DEA_NUMBER", rf"{B}([A-Z]{{2}}\d{{7}}){B}", 0.90, 1),
    ("NPI_NUMBER", _named("NPI", run(10)), 0.90, 1),
    ("NPI_NUMBER", _keyed(r"national\s+provider\s+identifier", run(10)), 1.05, 2),
    ("MEDICAL_LICENSE", _keyed(r"medical\s+license|license", run(4, 15, ALNUM), r"\s*(?:number|#)?"), 1.05, 2),
    ("MEDICAL_LICENSE", _named("MD", run(4, 15, ALNUM)), 0.90, 1),
    ("PATIENT_ID", _keyed(r"patient\s+(?:id|identifier|number)", run(4, 12, ALNUM)), 0.95, 2),
    ("PATIENT_ID", _named("PID", run(4, 12, ALNUM)), 0.85, 1),
    ("INSURANCE_POLICY", _keyed(r"policy" + _NUM, run(6, 20, ALNUM)), 0.95, 2),
    ("INSURANCE_POLICY", _keyed(r"insurance\s+(?:id|number)", run(6, 20, ALNUM)), 0.95, 2),
    ("PRESCRIPTION_NUMBER", _keyed("prescription|rx", run(6, 15, ALNUM), _NUM), 0.95, 2),
    ("PRESCRIPTION_NUMBER", _named("RX", run(6, 15, ALNUM)), 0.80, 1),
    ("ICD_CODE", _named(r"ICD[-\s]?(?:9|10)", _LETTER_CODE), 0.90, 1),
    ("ICD_CODE", rf"{B}({_LETTER_CODE}){B}", 0.80, 1),
    ("CPT_CODE", _named("CPT", run(5)), 0.80, 1),
    ("CPT_CODE", rf"{B}(\d{{5}}){B}", 0.80, 1),
    ("BANK_ACCOUNT", _keyed("account" + _NUM, run(8, 17)), 0.95, 2),
    ("BANK_ACCOUNT", _keyed("acct", run(8, 17)), 0.90, 2),
    ("ROUTING_NUMBER", _keyed("routing" + _NUM, run(9)), 0.85, 2),
    ("ROUTING_NUMBER", _keyed("ABA", run(9)), 0.80, 2),
    ("SWIFT_CODE", _keyed("SWIFT|BIC", "[A-Z]{6}" + ALNUM + "{2}(?:" + ALNUM + "{3})?"), 1.00, 2),
    ("IBAN", _named("IBAN", "[A-Z]{2}" + run(2) + ALNUM + "{4}" + run(7) + ALNUM + "{0,16}"), 0.90, 1),
    ("INVESTMENT_ACCOUNT", _keyed("investment|brokerage", run(6, 15, ALNUM), r"\s+account"), 0.90, 2),
    ("TAX_ID", _keyed(r"tax\s+(?:id|identification)", r"\d{2}-?\d{7}"), 0.95, 2),
    ("TAX_ID", _named("EIN", r"\d{2}-?\d{7}"), 0.80, 1),
    ("API_KEY", keyed(rf"{B}(api[_\s]?key)\s*[:=]\s*{_QUOTE}([A-Za-z0-9]{{20,}}){_QUOTE}", "api"), 0.90, 2),
    ("API_KEY", keyed(rf"{B}(token)\s*[:=]\s*{_QUOTE}([A-Za-z0-9]{{20,}}){_QUOTE}", "token"), 0.80, 2),
    ("DATABASE_CONNECTION", keyed(r"((?:mongodb|mysql|postgresql|redis)://)\S+", "mongodb", "mysql", "postgresql", "redis"), 0.80, 1),
    ("DATABASE_CONNECTION", keyed(rf"""{B}(connection\s+string)\s*[:=]\s*{_QUOTE}([^"']+){_QUOTE}""", "connection"), 0.90, 2),
    ("IP_ADDRESS_PRIVATE", rf"{B}(10\.{_HALF}{{2}}\d{{1,3}}){B}", 0.80, 1),
    ("IP_ADDRESS_PRIVATE", rf"{B}(192\.168\.{_HALF}\d{{1,3}}){B}", 0.80, 1),
    ("IP_ADDRESS_PRIVATE", rf"{B}(172\.(?:1[6-9]|2\d|3[01])\.{_HALF}\d{{1,3}}){B}", 0.90, 1),
    ("MAC_ADDRESS", rf"{B}([0-9a-f]{{2}}[:-]){{5}}([0-9a-f]{{2}}){B}", 0.80, 2),
    ("UUID", keyed(B + "-".join(f"[0-9a-f]{{{n}}}" for n in (8, 4, 4, 4, 12)) + B, "-"), 0.90, 0),
    ("JWT_TOKEN", keyed(rf"{B}(eyJ[\w-]+\.eyJ[\w-]+\.[\w-]+){B}", "eyj"), 0.90, 1),
    ("PRIVATE_KEY", _armour(r"(?:RSA\s+)?"), 0.90, 0),
    ("PRIVATE_KEY", _armour(r"OPENSSH\s+"), 0.90, 0),
    ("AWS_ACCESS_KEY", keyed(rf"{B}(AKIA[0-9A-Z]{{16}}){B}", "akia"), 0.80, 1),
    ("GCP_API_KEY", keyed(rf"{B}(AIza[\w-]{{35}}){B}", "aiza"), 0.80, 1),
))
