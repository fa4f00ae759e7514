"""Decoding of bank narrations into channel, merchant, card, reference and bank.

Each bank has an ordered rule list; the first rule whose condition holds fills the result
struct. All rules are built-in Column expressions, so decoding needs neither Python nor a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.functions.logic import first_match
from casetrail.functions.text import extract, null_if_empty, squeeze, strip

# Bank short codes and IFSC prefixes.
BANK_CODES = {
    "HDFC": "HDFC Bank",
    "ICIC": "ICICI Bank",
    "SBIN": "State Bank of India",
    "UTIB": "Axis Bank",
    "AXIS": "Axis Bank",
    "KKBK": "Kotak Mahindra Bank",
    "YESB": "YES Bank",
    "IDFB": "IDFC First Bank",
    "IDIB": "Indian Bank",
    "IOBA": "Indian Overseas Bank",
    "IBKL": "IDBI Bank",
    "BARB": "Bank of Baroda",
    "PUNB": "Punjab National Bank",
    "CNRB": "Canara Bank",
    "UBIN": "Union Bank of India",
    "CBIN": "Central Bank of India",
    "BKID": "Bank of India",
    "UCBA": "UCO Bank",
    "MAHB": "Bank of Maharashtra",
    "CITI": "Citibank",
    "HSBC": "HSBC",
    "SCBL": "Standard Chartered",
    "DEUT": "Deutsche Bank",
    "RATN": "RBL Bank",
    "FDRL": "Federal Bank",
    "SIBL": "South Indian Bank",
    "KARB": "Karnataka Bank",
    "INDB": "IndusInd Bank",
    "HDFCBANK": "HDFC Bank",
    "HDFCBAN": "HDFC Bank",
    "SBI": "State Bank of India",
    "PNB": "Punjab National Bank",
}
# Beginnings of spelled-out bank names, in matching order.
BANK_NAME_STARTS = (
    ("BANK OF BARODA", "Bank of Baroda"),
    ("BANK OF BAR", "Bank of Baroda"),
    ("BANK OF INDIA", "Bank of India"),
    ("BANK OF MAHARASHTRA", "Bank of Maharashtra"),
    ("STATE BANK OF", "State Bank of India"),
    ("PUNJAB NATIONAL", "Punjab National Bank"),
    ("ICICI", "ICICI Bank"),
    ("HDFC", "HDFC Bank"),
    ("AXIS", "Axis Bank"),
    ("KOTAK", "Kotak Mahindra Bank"),
    ("YES BANK", "YES Bank"),
    ("IDFC", "IDFC First Bank"),
    ("INDUSIND", "IndusInd Bank"),
    ("FEDERAL", "Federal Bank"),
    ("CANARA", "Canara Bank"),
    ("UNION BANK", "Union Bank of India"),
    ("CENTRAL BANK", "Central Bank of India"),
    ("UCO", "UCO Bank"),
    ("INDIAN BANK", "Indian Bank"),
    ("PAYTM", "Paytm Payments Bank"),
    ("AIRTEL", "Airtel Payments Bank"),
)
# Narrations that mean the same at every bank (squeezed, upper case).
STATIC_EVENTS = (
    ("TAXDEDUCTED", "tds", "Income Tax Department"),
    ("CREDITINTERESTCAPITALISED", "interest_credit", "Savings Interest Credit"),
    ("INTERESTCAPITALISED", "interest_credit", "Savings Interest Credit"),
    ("SMSCHARGES", "bank_charge", "SMS Charges"),
    ("SMSCHGS", "bank_charge", "SMS Charges"),
    ("AMCINCLGST", "bank_charge", "AMC Fee"),
    ("ATMCHG", "bank_charge", "ATM Charges"),
)
# Text printed behind the merchant of a card purchase, in matching order.
MERCHANT_TAILS = (
    "POSDEBIT", "POSSDEBIT", "POS DEBIT", "POS SDEBIT",
    "SDEBIT", "PO SDEBIT", "POS DEBI T", "POSDE BIT",
)
# Decoder channel to ledger channel.
LEDGER_CHANNELS = {
    "atm_hdfc": "atm",
    "atm_other": "atm",
    "pos": "pos",
    "upi": "upi",
    "imps": "imps",
    "neft": "neft",
    "rtgs": "rtgs",
    "tpt": "transfer",
    "ib_xfer": "transfer",
    "cheque_deposit": "cheque",
    "cheque_paid": "cheque",
    "cash_deposit": "cash",
    "tds": "tax",
    "interest_credit": "interest",
    "bank_charge": "fees",
    "fuel_reversal": "reversal",
    "bill_pay": "bill",
    "ecs": "ecs",
}
# Rules that overrule a given channel and counterparty.
HARD_RULES = (
    "atm", "chqdep", "chqpaid", "clg_brk", "ib_xfer:cr", "ib_xfer:dr", "static", "by_cash",
    "crvpos_fuel", "mir_charge", "bil_inft",
)
# Fragment patterns.
CARD = r"\d{6}[X*]{4,8}\d{4}"
IFSC = r"[A-Z]{4}0[A-Z0-9]{6}"
HANDLE = r"([A-Za-z0-9._-]+)@([A-Za-z]+)"

NOT_DECODED = ("unmatched", "no_decoder")


def _null() -> Column:
    return F.lit(None).cast("string")


def identify_bank(token: Column) -> Column:
    """Bank name of a short code, an IFSC, a name beginning or a code beginning."""
    names = F.create_map(*[F.lit(x) for pair in BANK_CODES.items() for x in pair])
    text = F.upper(strip(token))
    ifsc = extract(text, f"({IFSC})")
    by_length = sorted(BANK_CODES, key=len, reverse=True)
    cases = [
        (names[text].isNotNull(), names[text]),
        (ifsc.isNotNull(), names[F.substring(ifsc, 1, 4)]),
        *[(F.startswith(text, F.lit(start)), F.lit(name)) for start, name in BANK_NAME_STARTS],
    ]
    by_code = names[extract(text, f"^({'|'.join(by_length)})")]
    return F.when(F.length(token) > 0, first_match(cases, by_code))


def titlecase(name: Column) -> Column:
    """Merchant spelling: symbols out, short capital tokens kept, other tokens capitalised."""
    words = F.split(strip(F.regexp_replace(name, r"[^A-Za-z0-9 &'-]", " ")), r"\s+")

    def spell(word: Column) -> Column:
        acronym = (F.length(word) <= 4) & word.rlike("[A-Z]") & ~word.rlike("[a-z]")
        return F.when(acronym, word).otherwise(F.initcap(word))

    return null_if_empty(F.array_join(F.transform(words, spell), " "))


def strip_tails(name: Column, tails: tuple[str, ...] = MERCHANT_TAILS) -> Column:
    text = strip(F.upper(name))
    cases = [
        (
            F.endswith(text, F.lit(tail)),
            strip(F.substring(text, F.lit(1), F.length(text) - len(tail))),
        )
        for tail in tails
    ]
    return first_match(cases, text)


def card_last4(masked: Column) -> Column:
    return extract(masked, r"(\d{4})$")


def static_event(compact_upper: Column) -> tuple[Column, Column]:
    """Channel and merchant of a narration every bank words alike; null if none."""
    hits = [(F.startswith(compact_upper, F.lit(k)), c, m) for k, c, m in STATIC_EVENTS]
    return (
        first_match([(hit, F.lit(c)) for hit, c, _ in hits], _null()),
        first_match([(hit, F.lit(m)) for hit, _, m in hits], _null()),
    )


@dataclass(frozen=True)
class Rule:
    """One decoder rule; plain texts become literals, missing values null.

    ``name`` and ``place`` are spelled by ``titlecase``, ``card`` is cut to its last digits and
    ``tokens`` are looked up by ``identify_bank``, all once per row after a rule is chosen. The
    merchant is ``merchant`` as it stands, else ``prefix`` and the spelled name, else ``otherwise``.
    """

    rule: Column | str
    when: Column
    channel: Column | str
    name: Column | None = None
    merchant: Column | str | None = None
    prefix: Column | str | None = None
    otherwise: Column | str | None = None
    place: Column | None = None
    card: Column | None = None
    ref: Column | None = None
    bank: str | None = None
    tokens: tuple[Column, ...] = ()

    def pieces(self, null: Column) -> Column:
        def column(value: Column | str | None) -> Column:
            if value is None:
                return null
            return F.lit(value) if isinstance(value, str) else value

        tokens = (*self.tokens, None, None)
        named = {
            "rule": self.rule, "channel": self.channel, "name": self.name, "merchant": self.merchant,
            "prefix": self.prefix, "otherwise": self.otherwise, "place": self.place, "card": self.card,
            "ref": self.ref, "bank": self.bank, "token": tokens[0], "token2": tokens[1],
        }
        return F.struct(*[column(value).alias(key) for key, value in named.items()])


def _finish(p: Column) -> Column:
    """Chosen pieces as the public result struct."""
    name = titlecase(p["name"])
    spelled = F.when(name.isNotNull(), F.concat(F.coalesce(p["prefix"], F.lit("")), name))
    return F.struct(
        p["channel"].alias("channel"),
        F.coalesce(p["merchant"], spelled, p["otherwise"]).alias("merchant"),
        titlecase(p["place"]).alias("location"),
        card_last4(p["card"]).alias("card_last4"),
        p["ref"].alias("ref_number"),
        F.coalesce(p["bank"], identify_bank(p["token"]), identify_bank(p["token2"])).alias("counterparty_bank"),
        p["rule"].alias("matched_rule"),
    )


@dataclass(frozen=True)
class Text:
    """A narration with the views that the rules look at."""

    raw: Column
    upper: Column
    compact: Column
    parts: Column
    trailing: Column

    def part(self, i: int) -> Column:
        return F.get(self.parts, F.lit(i))

    def head(self) -> Column:
        return F.upper(self.part(0))

    def has(self, n: int) -> Column:
        return F.size(self.parts) >= n


def _static_rule(text: Text, bank: str | None, ref: Column | None = None) -> Rule:
    channel, merchant = static_event(F.upper(text.compact))
    return Rule("static", channel.isNotNull(), channel, merchant=merchant, ref=ref, bank=bank)


def _wire_rule(text: Text) -> Rule:
    """NEFT/RTGS, slash-separated: reference, remitter, bank."""
    kind = F.lower(text.part(0))
    return Rule(kind, text.head().isin("NEFT", "RTGS") & text.has(2), kind, text.part(2),
                ref=text.part(1), tokens=(text.part(3),))


def _says_nothing(name: Column) -> Column:
    """Whether a name spells to nothing at all."""
    return ~F.coalesce(name, F.lit("")).rlike("[A-Za-z0-9&'-]")


def _hdfc_savings(text: Text) -> list[Rule]:
    raw, compact = text.raw, text.compact
    channel, merchant = static_event(F.upper(compact))
    pos = rf"(?i)^POS({CARD})(.+?)(?:PO\s*S?DEBIT|POS\s*DEBIT|SDEBIT)\s*$"
    posref = rf"(?i)^POSREF({CARD})-(\d{{2}}/\d{{2}})(.+)$"
    crvpos = rf"(?i)^CRVPOS({CARD})(.+)$"
    atm = rf"(?i)^(ATW|NWD)-({CARD})-([A-Z0-9]+)-([A-Z]+?)(?:HDFCBAN.*)?$"
    tpt = r"(?i)^(\d{10,})-TPT-(.+)$"
    chqdep, chqpaid = r"(?i)^CHQDEP-MICRCLG-(.+)$", r"(?i)^CHQPAID-MICRCTS-(?:NO-)?(.+)$"
    between = r"(?i)^IBFUNDSTRANSFER(CR|DR)-(\d+)$"
    p2p = r"(?i)^\.?IMPSP2P(\d+)#\d{2}/\d{2}/\d{4}\d*\s*-MIR(\d+).*$"
    imps = r"(?i)^IMPS-(\d+)-(.+?)(?:-([A-Z]{3,5}))?-X\s*.*$"
    mir = r"(?i)^([A-Z]{4,})-([A-Z]+-[A-Z]+\d*)-\d+-MIR.*$"
    ach = r"(?i)^ACH([DC])-([A-Z0-9]+)-(.+)$"
    emi = r"(?i)^EMI(\d+)CHQS\d+.*$"
    upi, upi_name = r"(?i)^UPI-([A-Z0-9]+)-(.+)$", r"(?i)^UPI-([A-Z0-9]+)\s*$"

    tag = F.upper(extract(compact, crvpos, 2))
    own_atm = F.upper(extract(compact, atm, 1)) == "ATW"
    place = extract(compact, atm, 4)
    branch = F.regexp_replace(extract(raw, chqdep), ",", " ")
    spaceless = F.replace(raw, F.lit(" "), F.lit(""))
    rest = extract(spaceless, upi, 2)
    handle = F.regexp_replace(F.upper(extract(rest, r"(?i)@([A-Z]+)")), "^OK", "")
    interest = F.when(channel == "interest_credit", F.lit("HDFC Bank — Savings Interest"))
    return [
        Rule("static", channel.isNotNull(), channel, merchant=F.coalesce(interest, merchant)),
        Rule("pos", compact.rlike(pos), "pos", strip_tails(extract(compact, pos, 2)),
             card=extract(compact, pos, 1)),
        Rule("posref", compact.rlike(posref), "pos", extract(compact, posref, 3),
             card=extract(compact, posref, 1), ref=extract(compact, posref, 2)),
        Rule("crvpos_fuel", compact.rlike(crvpos) & tag.rlike("FUEL|DISCOUNTONFUE"), "fuel_reversal",
             merchant="Fuel Surcharge Reversal", card=extract(compact, crvpos, 1)),
        Rule("crvpos_other", compact.rlike(crvpos), "fuel_reversal", tag, card=extract(compact, crvpos, 1)),
        Rule("atm", compact.rlike(atm), F.when(own_atm, F.lit("atm_hdfc")).otherwise("atm_other"), place,
             prefix=F.when(own_atm, F.lit("HDFC Bank ATM — ")).otherwise("Non-HDFC ATM — "),
             place=place, card=extract(compact, atm, 2), ref=extract(compact, atm, 3), bank="HDFC Bank"),
        Rule("tpt", raw.rlike(tpt), "tpt", extract(raw, tpt, 2), ref=extract(raw, tpt, 1)),
        Rule("chqdep", raw.rlike(chqdep), "cheque_deposit", branch, prefix="Cheque Deposit — ",
             otherwise="Cheque Deposit — None", place=branch),
        Rule("chqpaid", raw.rlike(chqpaid), "cheque_paid", extract(raw, chqpaid)),
        Rule(F.concat(F.lit("ib_xfer:"), F.lower(extract(compact, between, 1))), compact.rlike(between), "ib_xfer",
             merchant=F.concat(F.lit("HDFC A/c "), F.right(extract(compact, between, 2), F.lit(4))),
             ref=extract(compact, between, 2), bank="HDFC Bank"),
        Rule("imps_p2p", raw.rlike(p2p), "imps", merchant="IMPS P2P Transfer", ref=extract(raw, p2p, 2)),
        Rule("imps", raw.rlike(imps), "imps", extract(raw, imps, 2), ref=extract(raw, imps, 1),
             tokens=(extract(raw, imps, 3),)),
        Rule("mir_charge", raw.rlike(mir), "ecs",
             merchant=F.concat(F.lit("HDFC — "), F.upper(extract(raw, mir, 1)), F.lit(" charge"))),
        Rule(F.concat(F.lit("ach_"), F.lower(extract(raw, ach, 1))), raw.rlike(ach),
             F.when(F.upper(extract(raw, ach, 1)) == "D", F.lit("ecs")).otherwise("ecs_credit"),
             extract(raw, ach, 3), ref=extract(raw, ach, 2)),
        Rule("emi_chqs", raw.rlike(emi), "ecs", merchant="Loan EMI", ref=extract(raw, emi), bank="HDFC Bank"),
        Rule("upi_modern", spaceless.rlike(upi), "upi", extract(spaceless, upi, 1),
             ref=extract(rest, r"\b(\d{10,})\b"), tokens=(handle, extract(F.upper(rest), f"({IFSC})"))),
        Rule("upi_name_only", spaceless.rlike(upi_name), "upi", extract(spaceless, upi_name)),
    ]


def _icici(text: Text) -> list[Rule]:
    raw, part, head = text.raw, text.part, text.head()
    cash = r"(?i)^BY\s+CASH\s*-\s*(.+)$"
    clearing = r"(?i)^CLG/([^/]+?)\s*/?\s*BRK\s+(\d+)\s*$"
    purpose = F.coalesce(part(2), F.lit(""))
    generic = F.upper(purpose).isin("NA", "UPI", "") | F.startswith(F.upper(purpose), F.lit("PAYMENT FROM"))
    address = F.coalesce(extract(part(3), HANDLE), part(3))
    no_note = F.upper(F.coalesce(part(3), F.lit(""))).isin("NA", "MIB-", "")
    return [
        _static_rule(text, "ICICI Bank"),
        Rule("by_cash", raw.rlike(cash), "cash_deposit", extract(raw, cash), prefix="Cash Deposit — ",
             otherwise="Cash Deposit — None", place=extract(raw, cash), bank="ICICI Bank"),
        Rule("upi", (head == "UPI") & text.has(3), "upi", F.when(generic, address).otherwise(purpose),
             ref=part(1), tokens=(part(4),)),
        Rule("mmt_imps", (head == "MMT") & text.has(3) & (F.upper(part(1)) == "IMPS"), "imps",
             F.coalesce(null_if_empty(part(4)), part(3)), ref=part(2), tokens=(part(5),)),
        Rule("bil_inft", (head == "BIL") & (F.upper(part(1)) == "INFT"), "ib_xfer", F.when(~no_note, part(3)),
             otherwise=F.when(no_note, F.lit("Internet Banking Transfer")), ref=part(2), bank="ICICI Bank"),
        Rule("bil_bpay", (head == "BIL") & (F.upper(part(1)) == "BPAY"), "bill_pay", part(3), ref=part(2)),
        _wire_rule(text),
        Rule("clg_brk", (head == "CLG") & raw.rlike(clearing), "cheque_paid", extract(raw, clearing, 1),
             ref=extract(raw, clearing, 2)),
        Rule("clg_other", (head == "CLG") & text.has(2), "cheque_paid", part(1)),
        Rule("vps", (head == "VPS") & text.has(3), "pos", part(2), ref=part(1)),
    ]


def _idfc(text: Text) -> list[Rule]:
    part, head = text.part, text.head()
    direction = F.upper(part(1))
    rule = F.when(direction == "DR", F.lit("upi_dr")).when(direction == "CR", F.lit("upi_cr")).otherwise("upi")
    no_name = _says_nothing(part(3)) | part(3).rlike(r"(?i)^[^A-Z0-9 &'-]*NA[^A-Z0-9 &'-]*$")
    return [
        _static_rule(text, "IDFC First Bank"),
        Rule(rule, (head == "UPI") & text.has(3), "upi",
             F.when(no_name, F.coalesce(extract(part(5), HANDLE), part(3))).otherwise(part(3)),
             ref=part(2), tokens=(part(4),)),
        Rule("imps", (head == "IMPS") & text.has(3), "imps", part(3), ref=part(2)),
        _wire_rule(text),
        Rule("atm_generic", text.upper.rlike("^ATM |ATM WITHDRAWAL"), "atm_hdfc", merchant="ATM Withdrawal",
             bank="IDFC First Bank"),
    ]


KOTAK_TRAILING_REF = r"(?i)\s+(?:UPI|MB|IMPS|NEFT|RTGS)-(\d{10,}).*$"


def _kotak(text: Text) -> list[Rule]:
    core, upper, trailing = text.raw, text.upper, text.trailing
    filled = F.filter(text.parts, lambda p: p != "")
    second, third = F.get(filled, F.lit(1)), F.get(filled, F.lit(2))
    sent, label = r"(?i)^MB\s+SENT\s+TO\s*(.*)$", r"(?i)^MB\s+(.+)$"
    wire = r"(?i)^(NEFT|RTGS)[-/]([A-Z0-9]+)[-/]?(.*)$"
    bare = r"(?i)^IMPS-(\d+)\s*(.*)$"
    kind, own = F.lower(extract(core, wire, 1)), "Kotak Mahindra Bank"
    return [
        _static_rule(text, own, trailing),
        Rule("mb_received", upper.rlike("^MB:RECEIVED"), "imps", merchant="Incoming Transfer", ref=trailing, bank=own),
        Rule("mb_sent_to", core.rlike(sent), "imps", extract(core, sent), otherwise="Outgoing Transfer", ref=trailing),
        Rule("mb_generic", core.rlike(label), "mobile_banking", extract(core, label), ref=trailing),
        Rule("upi", upper.rlike("^UPI/"), "upi", second, ref=trailing),
        Rule("pcd", upper.rlike("^PCD/"), "pos", F.coalesce(third, second),
             ref=F.coalesce(extract(second, r"^(\d+)$"), trailing)),
        Rule(kind, core.rlike(wire), kind, extract(core, wire, 3), ref=extract(core, wire, 2)),
        Rule("atm", upper.rlike("ATM") & upper.rlike("CASH|WDL|WITHDRAW"), "atm_other", merchant="ATM Withdrawal",
             ref=trailing, bank=own),
        Rule("imps_bare", core.rlike(bare), "imps", extract(core, bare, 2),
             otherwise=F.when(extract(core, bare, 2).isNull(), F.lit("IMPS Transfer")), ref=extract(core, bare, 1)),
    ]


def _axis(text: Text) -> list[Rule]:
    raw, part, head = text.raw, text.part, text.head()
    card = r"(?i)^POS/(\d{4,})/([^/]+)(?:/(.+))?$"
    atm = r"(?i)^ATM-?CASH[/\s]*([A-Z ,]+?)(?:[/\s]([A-Z0-9]+))?$"
    cheque = r"(?i)^BRN-CLG-CHQ\s+(PAID|DEPOSIT)\s*(.*)$"
    ecs, cms = r"(?i)^ECS[/-]([A-Z0-9]+)[/-](.+)$", r"(?i)^CMS-([A-Z0-9]+)-(.+)$"
    way = F.lower(extract(raw, cheque, 1))
    paid, own = way == "paid", "Axis Bank"
    legacy = F.when(F.upper(part(2)) != "NA", part(2))
    return [
        _static_rule(text, own),
        Rule(F.concat(F.lit("upi_"), F.lower(part(1))),
             (head == "UPI") & text.has(3) & F.upper(part(1)).isin("P2A", "P2M", "P2P"), "upi",
             F.when(_says_nothing(part(3)), extract(part(4), HANDLE)).otherwise(part(3)), ref=part(2)),
        Rule("upi", (head == "UPI") & text.has(3), "upi",
             F.when(_says_nothing(legacy), extract(part(3), HANDLE)).otherwise(legacy), ref=part(1),
             tokens=(part(4),)),
        Rule("imps", (head == "IMPS") & text.has(3), "imps", part(3), ref=part(2), tokens=(part(4),)),
        _wire_rule(text),
        Rule("inb", (head == "INB") & text.has(2), "ib_xfer", part(2),
             otherwise=F.when(F.coalesce(part(2), F.lit("")) == "", F.lit("Internet Banking Transfer")),
             ref=part(1), bank=own),
        Rule("pos", raw.rlike(card), "pos", extract(raw, card, 2), place=extract(raw, card, 3),
             card=extract(raw, card, 1)),
        Rule("atm", raw.rlike(atm), "atm_other", merchant="ATM Withdrawal", place=extract(raw, atm, 1),
             ref=extract(raw, atm, 2), bank=own),
        Rule(F.concat(F.lit("brn_clg_"), way), raw.rlike(cheque),
             F.when(paid, F.lit("cheque_paid")).otherwise("cheque_deposit"), extract(raw, cheque, 2),
             otherwise=F.when(paid, F.lit("Cheque Paid")).otherwise("Cheque Deposit")),
        Rule("ecs", raw.rlike(ecs), "ecs", extract(raw, ecs, 2), ref=extract(raw, ecs, 1)),
        Rule("cms", raw.rlike(cms), "ecs", extract(raw, cms, 2), ref=extract(raw, cms, 1)),
    ]


def _sbi(text: Text) -> list[Rule]:
    raw, upper = text.raw, text.upper
    upi = r"(?i)^(?:TO|BY)\s+TRANSFER-UPI/([^/]+)(?:/(\S+))?"
    imps = r"(?i)^(?:TO|BY)\s+TRANSFER-IMPS[/\s-]*(\d+)[-/\s]*(.+)?"
    wire = r"(?i)^(?:TO|BY)\s+TRANSFER-(NEFT|RTGS)[-/\s]*([A-Z0-9]+)[-/\s]*(.+)?"
    inb = r"(?i)^(?:TO|BY)\s+TRANSFER-INB\s+(.+?)(?:-(\S+))?$"
    atm = (
        r"(?i)^TO\s+ATM\s+(?:WDL|WITHDRAWAL)[-/\s]*([A-Z0-9]+)?[-/\s]*([A-Z ]+?)"
        r"(?:[-/\s](\d{4,}))?$"
    )
    pos = r"(?i)^TO\s+POS\s+(\d+)[-/\s]*(.+)$"
    cheque_in, cheque_out = r"(?i)^BY\s+CLEARING-(\d+)-(.+)$", r"(?i)^TO\s+CHQ-?(\d+)[-\s]*(.+)$"
    cash = r"(?i)^BY\s+CASH[-\s]*(.+)$"
    address = extract(raw, upi, 1)
    kind, own = F.lower(extract(raw, wire, 1)), "State Bank of India"
    sms = F.when(upper.rlike("SMS"), F.lit("SBI — SMS Charges")).otherwise("SBI — MAB Charges")
    return [
        _static_rule(text, own),
        Rule("interest_cr", upper.rlike("CREDIT INTEREST"), "interest_credit", merchant="SBI — Savings Interest", bank=own),
        Rule("interest_dr", upper.rlike("DEBIT INTEREST"), "interest_debit", merchant="SBI — Overdraft Interest", bank=own),
        Rule("sbi_chg", upper.rlike(r"SB\s+(SMS|MAB)\s+CHRG"), "bank_charge", merchant=sms),
        Rule("upi", raw.rlike(upi), "upi", F.coalesce(extract(address, HANDLE), address), ref=extract(raw, upi, 2),
             tokens=(extract(address, HANDLE, 2),)),
        Rule("imps", raw.rlike(imps), "imps", extract(raw, imps, 2), ref=extract(raw, imps, 1)),
        Rule(kind, raw.rlike(wire), kind, extract(raw, wire, 3), ref=extract(raw, wire, 2)),
        Rule("inb", raw.rlike(inb), "ib_xfer", extract(raw, inb, 1), ref=extract(raw, inb, 2), bank=own),
        Rule("atm", raw.rlike(atm), "atm_other", extract(raw, atm, 2), prefix="SBI ATM — ",
             otherwise="SBI ATM Withdrawal", place=extract(raw, atm, 2), card=extract(raw, atm, 3),
             ref=extract(raw, atm, 1), bank=own),
        Rule("pos", raw.rlike(pos), "pos", extract(raw, pos, 2), ref=extract(raw, pos, 1)),
        Rule("cheque_in", raw.rlike(cheque_in), "cheque_deposit", extract(raw, cheque_in, 2),
             ref=extract(raw, cheque_in, 1)),
        Rule("cheque_out", raw.rlike(cheque_out), "cheque_paid", extract(raw, cheque_out, 2),
             ref=extract(raw, cheque_out, 1)),
        Rule("cash", raw.rlike(cash), "cash_deposit", extract(raw, cash), prefix="Cash Deposit — ",
             otherwise="Cash Deposit — None", place=extract(raw, cash)),
    ]


# A decoder turns a narration into its ordered rules.
Decoder = Callable[[Text], list[Rule]]
DECODERS: dict[str, Decoder] = {
    "hdfc_savings": _hdfc_savings,
    "icici": _icici,
    "idfc": _idfc,
    "kotak": _kotak,
    "axis": _axis,
    "axis_savings": _axis,  # alias
    "sbi": _sbi,
}


def _rule_columns(decoders: Mapping[str, Decoder], key: Column) -> tuple[Column, Column]:
    """The number of the first matching rule, and the pieces of the rule with that number."""
    text = Text(*[F.col(name) for name in ("_raw", "_upper", "_compact", "_parts", "_trail")])
    null, per_bank, pieces, count = _null(), [], [], 0
    for name, decoder in decoders.items():
        rules = list(enumerate(decoder(text), start=count))
        count += len(rules)
        per_bank.append((key == name, first_match([(r.when, F.lit(i)) for i, r in rules], F.lit(-1))))
        pieces += [(F.col("_rule") == i, r.pieces(null)) for i, r in rules]
    nothing = F.when(F.col("_rule") == -2, F.lit("no_decoder")).otherwise("unmatched")
    unknown = Rule(nothing, F.lit(True), "unknown", ref=F.col("_trail")).pieces(null)
    return first_match(per_bank, F.lit(-2)), first_match(pieces, unknown)


@cache
def _default_rule_columns(bank: str) -> tuple[Column, Column]:
    return _rule_columns(DECODERS, F.col(bank))


def with_decoded(
    rows: DataFrame,
    bank: str = "bank",
    narration: str = "description",
    into: str = "decoded",
    decoders: Mapping[str, Decoder] | None = None,
) -> DataFrame:
    """Add the decoded struct of a narration; banks without a decoder give ``no_decoder``.

    The work is staged: text views first, then the number of the first matching rule, then the
    fields of that one rule. Each stage reads plain columns of the one before.
    """
    key = F.col(bank)
    raw = strip(F.coalesce(F.col(narration), F.lit("")))
    core = first_match(
        [
            (key == "kotak", strip(F.regexp_replace(raw, KOTAK_TRAILING_REF, ""))),
            (key == "idfc", F.regexp_replace(raw, r"\s+", " ")),
        ],
        raw,
    )
    staged = rows.withColumns(
        {"_raw": core, "_trail": F.when(key == "kotak", extract(raw, KOTAK_TRAILING_REF))}
    ).withColumns(
        {
            "_upper": F.upper("_raw"),
            "_compact": squeeze(F.col("_raw")),
            "_parts": F.transform(F.split("_raw", "/"), strip),
        }
    )
    number, pieces = _rule_columns(decoders, key) if decoders else _default_rule_columns(bank)
    return (
        staged.withColumn("_rule", number)
        .withColumn("_pieces", pieces)
        .withColumn(into, _finish(F.col("_pieces")))
        .drop("_raw", "_trail", "_upper", "_compact", "_parts", "_rule", "_pieces")
    )


def is_decoded(rule: Column) -> Column:
    return rule.isNotNull() & ~rule.isin(*NOT_DECODED)


def ledger_channel(channel: Column) -> Column:
    """Decoder channel in the vocabulary of the ledger; unknown gives null."""
    names = F.create_map(*[F.lit(x) for pair in LEDGER_CHANNELS.items() for x in pair])
    known = F.when((channel != "unknown") & (channel != ""), channel)
    return F.coalesce(names[known], known)


def stitch(rows: DataFrame, decoded: str = "decoded") -> DataFrame:
    """Merge decoder results into shaped rows.

    Card, reference and bank fill gaps. Hard rules also set the channel, and the counterparty
    when the given one is missing or shares no word with the decoded one.
    """
    d = F.col(decoded)
    hit = is_decoded(d["matched_rule"])
    rule = d["matched_rule"]
    hard = hit & (
        rule.isin(*HARD_RULES) | F.startswith(rule, F.lit("atm")) | F.startswith(rule, F.lit("ib_xfer"))
    )
    mapped = ledger_channel(d["channel"])
    given = null_if_empty(F.lower(strip(F.col("counterparty"))))

    def words(text: Column) -> Column:
        return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))

    disagrees = given.isNull() | ~F.arrays_overlap(words(given), words(d["merchant"]))

    def fill(name: str) -> Column:
        return F.coalesce(null_if_empty(F.col(name)), F.when(hit, null_if_empty(d[name])), F.col(name))

    channel = F.when(hard & mapped.isNotNull(), mapped).otherwise(
        F.coalesce(null_if_empty(F.col("channel")), F.when(hit, mapped), F.col("channel"))
    )
    party = F.when(
        hard & (F.length(d["merchant"]) > 0) & disagrees, d["merchant"]
    ).otherwise(F.col("counterparty"))
    return rows.withColumns(
        {
            "card_last4": fill("card_last4"),
            "ref_number": fill("ref_number"),
            "counterparty_bank": fill("counterparty_bank"),
            "channel": channel,
            "counterparty": party,
        }
    )


def coverage(rows: DataFrame, keys: list[str], decoded: str = "decoded") -> DataFrame:
    """Rows, matched rows, hit rate and rule histogram per group.

    Rules are counted first, so the histogram is built from a handful of rows per group.
    """
    rule = F.coalesce(F.col(f"{decoded}.matched_rule"), F.lit("unmatched"))
    per_rule = rows.groupBy(*keys, rule.alias("rule")).agg(F.count(F.lit(1)).alias("n"))
    matched = F.sum(F.when(is_decoded(F.col("rule")), F.col("n")).otherwise(0))
    return per_rule.groupBy(*keys).agg(
        F.sum("n").alias("rows_total"),
        matched.alias("rows_matched"),
        F.round(matched / F.sum("n"), 3).alias("hit_rate"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "n")))).alias("rules_fired"),
    )
