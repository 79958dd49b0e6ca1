"""The spreading template: rows, labels, formulas, ratios. Fixed values that results depend on."""

from __future__ import annotations

INCOME = ("sales_other_income",)
EXPENSE = ("purchases", "transport_admin", "employee_costs", "other_expenses", "interest_finance", "depreciation", "extraordinary")
TAX = ("provision_tax", "provision_deferred_tax", "preference_dividend")
LIABILITY = (
    "equity_capital", "preference_shares", "reserves", "secured_loan_asset_financed", "secured_loan_maturity_1yr", "secured_loan_ccod",
    "other_lt_liabilities", "unsecured_loans", "deferred_tax_liability", "sundry_creditors", "current_liabilities",
)
ASSET = ("fixed_assets", "intangible_assets", "investments", "deferred_tax_assets", "debtors", "current_assets", "lt_loans_advances", "other_non_current_assets")
PL_INPUTS, BS_INPUTS = INCOME + EXPENSE + TAX, LIABILITY + ASSET
INPUTS = PL_INPUTS + BS_INPUTS
PL_DERIVED = ("gross_receipts", "gross_expenses", "profit_before_tax", "profit_after_tax", "profit_available", "cash_profit")
BS_DERIVED = ("total_liabilities", "total_assets", "networth", "total_current_liabilities", "total_current_assets")
PL_KEYS, BS_KEYS = PL_INPUTS + PL_DERIVED, BS_INPUTS + BS_DERIVED
KEYS = PL_KEYS + BS_KEYS
OUTSIDE = LIABILITY[3:]

#: Sheet rows in order (kind, key, caption).
SHEET = (
    ("section", "", "PROFIT AND LOSS ACCOUNT"),
    ("item", "sales_other_income", "Sales and other Income"),
    ("total", "gross_receipts", "Gross Receipts"),
    ("item", "purchases", "Purchases & Raw Material"),
    ("item", "transport_admin", "Transport operation and admin charges"),
    ("item", "employee_costs", "Employee Costs"),
    ("item", "other_expenses", "Other Expenses"),
    ("item", "interest_finance", "Interest and Finance Expenses"),
    ("item", "depreciation", "Depreciation"),
    ("item", "extraordinary", "Extra Ordinary Item"),
    ("total", "gross_expenses", "Gross Expenses"),
    ("total", "profit_before_tax", "Profit before tax"),
    ("item", "provision_tax", "Provision for tax"),
    ("item", "provision_deferred_tax", "Provision for Deferred Tax"),
    ("item", "profit_after_tax", "Profit after tax"),
    ("item", "preference_dividend", "Preference dividend (including tax)"),
    ("item", "profit_available", "Profit available for equity shareholders"),
    ("item", "cash_profit", "Cash Profit"),
    ("section", "", "LIABILITIES"),
    ("item", "equity_capital", "Equity Capital"),
    ("item", "preference_shares", "Preference Shares"),
    ("item", "reserves", "Reserves & Surplus"),
    ("item", "secured_loan_asset_financed", "Secured loan - Asset Financed"),
    ("item", "secured_loan_maturity_1yr", "Secured loan maturity within one year"),
    ("item", "secured_loan_ccod", "Secured loan - CC/OD"),
    ("item", "other_lt_liabilities", "Other Long term liabilities"),
    ("item", "unsecured_loans", "Unsecured loans"),
    ("item", "deferred_tax_liability", "Deffered tax liability"),
    ("item", "sundry_creditors", "Sundry Creditors"),
    ("item", "current_liabilities", "Current Liabilities and Provision"),
    ("total", "total_liabilities", "Total of Liabilities"),
    ("section", "", "ASSETS"),
    ("item", "fixed_assets", "Fixed Assets"),
    ("item", "intangible_assets", "Intangible Assets"),
    ("item", "investments", "Investments"),
    ("item", "deferred_tax_assets", "Deffered Tax Assets"),
    ("item", "debtors", "Debtors / Receivables"),
    ("item", "current_assets", "Current assets, Loans and Advances"),
    ("item", "lt_loans_advances", "Long Term Loan & Advance"),
    ("item", "other_non_current_assets", "Other Non Current Assets"),
    ("total", "total_assets", "Total of Assets"),
)

#: Ratios: name, caption, numerator and denominator over template keys, factor.
EQUITY = "equity_capital + reserves + preference_shares"
RATIOS = (
    ("roce", "Return on Capital Employed", "profit_after_tax + interest_finance", f"{EQUITY} + secured_loan_asset_financed + unsecured_loans", ""),
    ("roe", "Return On Share Holders Fund", "profit_after_tax", EQUITY, ""),
    ("pat_income", "PAT / Income (%)", "profit_after_tax", "sales_other_income", ""),
    ("pat_assets", "PAT / Assets employed (%)", "profit_after_tax", "total_assets", ""),
    ("ltd_equity", "Long Term Debt / Equity (inclusive q/e)", "secured_loan_asset_financed + secured_loan_maturity_1yr", f"{EQUITY} + unsecured_loans", ""),
    ("tol_tnw", "Total Debt / Equity(inclusive q/e)", " + ".join(k for k in OUTSIDE if k != "unsecured_loans"), f"{EQUITY} + unsecured_loans", ""),
    ("interest_cover", "Interest Coverage", "profit_before_tax + interest_finance + depreciation", "interest_finance", ""),
    ("current_ratio", "Current Ratio", "debtors + current_assets", "sundry_creditors + current_liabilities + secured_loan_ccod + secured_loan_maturity_1yr", ""),
    ("dscr", "DSCR", "profit_after_tax + depreciation + interest_finance", "interest_finance + secured_loan_asset_financed / 4", ""),
    ("debtor_days", "Debtor Days", "debtors", "sales_other_income", " * 365"),
    ("creditor_days", "Creditor Days", "sundry_creditors", "sales_other_income", " * 365"),
)

SNAP = (
    ("turnover", "gross_receipts"),
    ("pat", "profit_after_tax"),
    ("cash_profit", "cash_profit"),
    ("networth", "equity_capital + preference_shares + reserves"),
    ("secured_long_term", "secured_loan_asset_financed + secured_loan_maturity_1yr"),
    ("secured_ccod", "secured_loan_ccod"),
    ("current_liabilities_provisions", "sundry_creditors + current_liabilities + secured_loan_maturity_1yr"),
    ("fixed_assets", "fixed_assets"),
    ("current_assets_advances", "debtors + current_assets"),
)
GROWTH = ("sales_other_income", "gross_expenses", "profit_before_tax", "profit_after_tax", "cash_profit", "total_assets", "total_liabilities")
TRENDS = ("sales_other_income", "gross_expenses", "profit_before_tax", "profit_after_tax", "cash_profit", "networth", "total_assets", "total_current_liabilities")
#: Live formulas of the derived sheet rows; ``{key}`` is that row's cell.
FORMULAS = {
    "gross_receipts": "IFERROR(SUM({sales_other_income}:{sales_other_income}),0)",
    "gross_expenses": "IFERROR(SUM({purchases}:{extraordinary}),0)",
    "profit_before_tax": "IFERROR({gross_receipts}-{gross_expenses},0)",
    "profit_after_tax": "{profit_before_tax}-{provision_tax}-{provision_deferred_tax}",
    "profit_available": "{profit_after_tax}+{preference_dividend}",
    "cash_profit": "IFERROR({profit_available}+{depreciation},0)",
    "total_liabilities": "SUM({equity_capital}:{current_liabilities})",
    "total_assets": "SUM({fixed_assets}:{other_non_current_assets})",
}
LAKH = 100_000
