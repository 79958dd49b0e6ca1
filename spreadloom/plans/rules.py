"""Label rules as data, compiled into CASE chains; first match wins."""

from __future__ import annotations

from spreadloom.plans.dialect import Spark
from spreadloom.plans.template import EXPENSE, INCOME, PL_INPUTS

#: Fixed values: (key, pattern, pattern that forbids it). Case-insensitive, free of look-around.
SYNONYMS = (
    ("sales_other_income", r"^\[INC\]", None),
    ("interest_finance", r"interest\s+(paid\s+)?on\s+\w[\w\s]*?\bloan", None),
    ("deferred_tax_liability", r"deferred\s+tax\s+liab", None),
    ("deferred_tax_assets", r"deferred\s+tax\s+asset|income[\s-]*tax\s+asset", None),
    ("equity_capital", r"\b(share\s+capital|equity\s+(share\s+)?capital|capital\s+account|proprietor'?s?\s+capital|partners?'?\s+capital|owner'?s?\s+capital)\b", None),
    ("preference_shares", r"preference\s+(share|capital)", None),
    ("reserves", r"\breserves?\b|surplus\b|other\s+equity|profit\s*(&|and)\s*loss\s+(a/?c|account)\s+balance", None),
    ("secured_loan_ccod", r"\b(cash\s+credit|cc|overdraft|od|working\s+capital\s+loan)\b", None),
    ("secured_loan_maturity_1yr", r"current\s+maturit", None),
    ("current_liabilities", r"short[\s-]*term\s+borrowing", None),
    ("current_assets", r"short[\s-]*term\s+loans?\s*(&|and)?\s*advance", None),
    ("debtors", r"trade\s+receivable|sundry\s+debtor|\bdebtors?\b|bills?\s+receivable", None),
    ("sundry_creditors", r"sundry\s+creditor|trade\s+payable|sundry\s+payable|\bcreditors?\b|outstanding\s+dues\s+of\s+(micro|creditors)|micro\s+and\s+small\s+enterprise", None),
    ("current_liabilities", r"^\[CL\]", None),
    ("current_assets", r"^\[CA\]", None),
    ("equity_capital", r"^\[EQ\]", None),
    ("current_assets", r"^\[(FA|INV)\].*\b(loans?\s*(&|and)\s*advances?|cash\s*(&|and)\s*bank|bank\s+balances?|cash\s+(in|on)\s+hand|cash-in-hand|sundry\s+debtors?|debtors?|receivables?|closing\s+stock|stock\s+in\s+hand|other\s+current\s+assets?)\b", None),
    ("secured_loan_asset_financed", r"^\[SL\]", None),
    ("unsecured_loans", r"^\[UL\]", None),
    ("fixed_assets", r"^\[FA\]", None),
    ("investments", r"^\[INV\]", None),
    ("other_lt_liabilities", r"^\[NCL\].*financial\s+liabilit", None),
    ("current_liabilities", r"other\s+financial\s+liabilit", None),
    ("current_assets", r"^\[CA\].*financial\s+asset", None),
    ("lt_loans_advances", r"long[\s-]*term\s+loans?\s*(&|and)?\s*advance", None),
    ("secured_loan_asset_financed", r"(^|[^n]|(^|[^u])n)secured\s+loan|term\s+borrowing|term\s+loan|\bborrowings?\b|vehicle\s+loan|hypothecat|loan\s+from\s+bank", None),
    ("unsecured_loans", r"unsecured\s+loan|lease\s+liabilit|loans?\s+from\s+(director|partner|relative|friend)", None),
    ("secured_loan_asset_financed", r"^\[LIAB\].*\bloans?\b", None),
    ("secured_loan_asset_financed", r"\bloans?\s*\(\s*liabilit", None),
    ("secured_loan_asset_financed", r"^\[LIAB\].*\b(finance|financial|bank|nbfc|capital\s+(ltd|limited))\b", None),
    ("other_lt_liabilities", r"(other\s+)?long[\s-]*term\s+(liabilit|borrowing|provision)|non[\s-]*current\s+liabilit", None),
    ("current_liabilities", r"outstanding\s+dues|micro\s+and\s+small\s+enterprise", None),
    ("current_liabilities", r"sundry\s+creditor|trade\s+payable|sundry\s+payable|current\s+liabilit|short[\s-]*term\s+(provision|borrowing)|duties\s*&?\s*taxes|outstanding\s+(expense|liabilit)|provision|payable\b", None),
    ("equity_capital", r"^\[EQ\]", None),
    ("intangible_assets", r"intangible", None),
    ("fixed_assets", r"fixed\s+asset|tangible\s+asset|property,?\s*plant|plant\s*(&|and)\s*machin|furniture|right[\s-]*of[\s-]*use|capital\s+work[\s-]*in[\s-]*progress", None),
    ("investments", r"^\[NCA\].*financial\s+asset", None),
    ("investments", r"\binvestment|shares?\s+(in|of)\b|gold\s*(&|and)?\s*ornament|fixed\s+deposit|\bFDR?\b", None),
    ("fixed_assets", r"\b(computers?|laptops?|mobiles?|bikes?|cars?|trucks?|truek|motor|tempo|lorry|air\s*-?\s*condi?tione?rs?|household\s+appliances?|printers?|machinery|equipments?)\b", r"^\[(INC|EXP)\]|\b(exp\.?|expenses?|repairs?|maint\w*|insurance|running|hire|rent|fuel|loan|emi)\b"),
    ("debtors", r"trade\s+receivable|sundry\s+debtor|\bdebtors?\b|bills?\s+receivable", None),
    ("other_non_current_assets", r"other\s+non[\s-]*current\s+asset|non[\s-]*current\s+asset", None),
    ("current_assets", r"receivable|closing\s+stock|inventor|cash\s*(&|and|\s+in\s+)|bank\s+balance|balance\s+with\s+bank|current\s+asset|short[\s-]*term\s+loans?|loans?\s*(&|and)\s*advance|current\s+investment", None),
    ("sales_other_income", r"^\[INC\]", None),
    ("depreciation", r"depreciation|amorti[sz]ation|\bdep\.?\b", None),
    ("interest_finance", r"finance\s+cost|interest\s*(&|and)?\s*(bank\s*)?charge|bank\s+(int|charge)", None),
    ("interest_finance", r"\binterest\b", r"\binterest\s+(income|received|on\s+(IT|income[\s-]*tax))"),
    ("employee_costs", r"employee|salar(y|ies)|wages|staff|bonus|pagar|labour|gratuity|provident", None),
    ("employee_costs", r"\b(esic|e\.s\.i\.c\.?|esi|pf)\b", r"\b(payable|dues?|outstanding)\b"),
    ("transport_admin", r"electricity|power\s*(&|and)?\s*fuel|light\s+bill|\bmseb\b|\bmsedcl\b", None),
    ("purchases", r"purchase|cost\s+of\s+material|raw\s+material|changes?\s+in\s+inventor|stock[\s-]*in[\s-]*trade", None),
    ("transport_admin", r"direct\s+expense|operating\s+(expense|cost)|cost\s+of\s+(services|operations)|transport|freight|die?sel|fuel|toll|tyre|tanker|\br\.?t\.?o\.?\b|road\s+tax|stores?\s*(&|and)?\s*spares?|hamali|vehicle\s+(running|expense)|repairs?\s*(&|and)?\s*maint|insurance", None),
    ("extraordinary", r"extra\s*[\s-]*ordinary|exceptional\s+item", None),
    ("provision_deferred_tax", r"deferred\s+tax(\s+expense)?\b", None),
    ("provision_deferred_tax", r"\bMAT\s+credit\b", r"^\[(NCA|CA|FA|INV)\]|\bMAT\s+credit\s+entitlement"),
    ("provision_tax", r"\b(current\s+tax|provision\s+for\s+tax|income[\s-]*tax\s+(expense|provision)|tax\s+expense)\b", None),
    ("preference_dividend", r"preference\s+dividend", None),
    ("sales_other_income", r"revenue\s+from\s+operation|gross\s+receipt|\bsales?\b|turnover|other\s+income|\bincome\s+from\b|\breceipts?\b|bus\s+fare|service\s+charge", None),
    ("other_expenses", r"rates?\s*(&|and)?\s*taxes?|expense|expenditure|charges?\b|fees?\b|rent\b|stationer|travel|mobile|internet|telephone|printing|postage|audit|legal|profession|miscellaneous|sundry|office|advertis|\bexp\.?\b|entertain|\bmedical\b|tea\s*(&|and)?\s*snack", None),
)

#: Lines that restate others. A total of outstanding dues is not one.
_LEAD = r"^\s*(\[[A-Z]{2,3}\]\s*)?([#\"'|*~`]+\s*)?((to|by)\s+)?([IVX]{1,4}[\s.)]+|\(?\d{1,2}\)?[\s.)]+)?(add\s*:?\s*|less\s*:?\s*)?"
SUBTOTAL = _LEAD + (
    r"(total|gross\s+total\b|profit\s+(before|after|for\s+the|available)|(nett?\s+)?profit\s*/?\s*\(?loss\b|loss\s+for\s+the|nett?\s+(profit|loss)\b|"
    r"(profit|loss)\s+(carried|transferred|c/?f)\b|gross\s+(pr\w{1,4}t|loss)\b|earnings?\s+per|e\.?p\.?s\b|basic\s*\(|basic\s*(&|and)\s*diluted|diluted|"
    r"carried\s+(to|forward)|balance\s+(c/?f|b/?f)|as\s+per\s+last\s+balance\s+sheet)"
)
NOT_SUBTOTAL = _LEAD + r"total\s+outstanding\s+dues"
EQUITY_PROFIT = r"^\[EQ\]\s*((add|by|to)\s*:?\s*)?(nett?\s+)?profit\b"
STOCK = r"^\[(INC|EXP)\].*\b(opening|closing)\s+stock\b"
CLOSING_STOCK = r"^\[(INC|EXP)\].*\bclosing\s+stock\b"
RESULT = r"nett?\s+(profit|loss)|profit\s+(before\s+tax|for\s+the)|(profit|loss)\s+(carried|transferred)"
BALANCE_TAG = r"^\s*\[(EQ|LIAB|CL|NCL|CA|NCA|FA|INV|SL|UL)\]"
IGNORED = "__ignored__"

#: Conventions worth telling, first match.
CONVENTIONS = (
    (r"^\[(INC|EXP)\].*\bopening\s+stock\b", "opening stock added to purchases"),
    (CLOSING_STOCK, "closing stock deducted from purchases"),
    (r"right[\s-]*of[\s-]*use", "leased assets grouped with fixed assets"),
    (r"lease\s+liabilit", "lease liabilities grouped with unsecured loans"),
    (r"income[\s-]*tax\s+asset", "income-tax assets grouped with deferred tax assets"),
    (r"^\[NCA\].*financial\s+asset", "non-current financial assets treated as investments"),
    (r"^\[CL\]", "current liability by its section"),
    (r"^\[CA\]", "current asset by its section"),
)
#: Section captions and their tags, first match.
SECTIONS = (
    (r"non\s*-?\s*current\s+liabilit", "NCL"),
    (r"non\s*-?\s*current\s+asset", "NCA"),
    (r"\bcurrent\s+liabilit", "CL"),
    (r"\bcurrent\s+asset", "CA"),
    (r"shareholders?'?\s+fund|(?:proprietor|partners?|owner)'?s?\s+capital|^\s*capital\s+a/?c(?:count)?\b", "EQ"),
    (r"^\s*(?:[A-Z]{1,4}\s*[\].):]\s*|[IVX]{1,4}\s+)?expen(?:ses?|diture)\s*[:\-\s]*$", "EXP"),
    (r"^\s*(?:[A-Z]{1,4}\s*[\].):]\s*|[IVX]{1,4}\s+)?(?:income|revenue)\s*[:\-\s]*$", "INC"),
    (r"^\s*secured\s+loan\s*:?\s*$", "SL"),
    (r"^\s*unsecured\s+loan\s*:?\s*$", "UL"),
    (r"^\s*fixed\s+assets?\s*:?\s*$", "FA"),
    (r"^\s*investments?\s*:?\s*$", "INV"),
    (r"\bequity\s*(?:&|and)\s*liabilit|^\s*loans?\s*\(\s*liabilit", "LIAB"),
)


def normal_label(d: Spark, x: str) -> str:
    return f"trim({d.replace(d.replace(f'lower({x})', '[^a-z0-9 ]+', ' ', True), ' +', ' ', True)})"


def map_label(d: Spark, x: str, learned: str | None = None) -> str:
    """An expression for the template key of a label, IGNORED, or NULL. ``learned`` is an expression of the learned key."""
    arms = [
        (d.match(x, EQUITY_PROFIT), "'equity_capital'"),
        (f"{d.match(x, SUBTOTAL)} AND NOT {d.match(x, NOT_SUBTOTAL)}", f"'{IGNORED}'"),
        (d.match(x, STOCK), "'purchases'"),
    ]
    if learned:
        arms.append((f"{learned} IS NOT NULL", learned))
    for key, pattern, forbidden in SYNONYMS:
        test = d.match(x, pattern)
        if forbidden:
            test += f" AND NOT {d.match(x, forbidden)}"
        if key in PL_INPUTS:
            test += f" AND NOT {d.match(x, BALANCE_TAG, True)}"
        if key in INCOME:
            test += f" AND NOT {d.match(x, r'^\s*\[EXP\]', True)}"
        if key in EXPENSE:
            test += f" AND NOT {d.match(x, r'^\s*\[INC\]', True)}"
        arms.append((test, f"'{key}'"))
    return "CASE " + " ".join(f"WHEN {t} THEN {k}" for t, k in arms) + " END"


def mapped_amount(d: Spark, label: str, amount: str) -> str:
    return f"CASE WHEN {d.match(label, CLOSING_STOCK)} THEN -abs({amount}) ELSE {amount} END"


def first_of(d: Spark, x: str, rules: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {d.match(x, p)} THEN {d.text(v)}" for p, v in rules) + " END"
