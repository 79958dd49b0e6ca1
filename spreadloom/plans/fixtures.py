"""Literal tables with the wording that the rules are about."""

NUMBERS = [(k, x) for k, x in enumerate(["12,34,567", "12,34,567.00", "₹ 1,000", "Rs. 1,000", "(1,234)", "1 23 456", "0", "", "-", None, "NA", "2.5", "-7", "1,35,24,153.00", "6,029.41"])]
LINES = [
    (k, x)
    for k, x in enumerate(
        ["TO NET PROFIT -4,391,651", "Short - Term Borrowings 50,000", "24,18,44,856 12,32,46,427", "Salary (1,20,000.00)", "Total 1,00,000", "Total outstanding dues of creditors 4,32,248",
         "Particulars", "Rent Rs. 12,000 AB", "Cash in hand 250", "Furniture 65,980.50", "Less : Dep @ 10 %", "By sales", "Net profit before tax 5,000", "for Rao Associates", "Chartered Accountants", "Note 12"]
    )
]
LABELS = [
    ("(a) Share Capital", "equity_capital"), ("[CL] Sundry Creditors", "sundry_creditors"), ("(b) Reserves and Surplus", "reserves"), ("Sundry Debtors & Other Receivable", "debtors"),
    ("[NCA] (b) Right-of-use assets", "fixed_assets"), ("(ii) Lease liabilities", "unsecured_loans"), ("Finance Costs", "interest_finance"), ("I Revenue from Operations", "sales_other_income"),
    ("Deferred Tax Liabilities (Net)", "deferred_tax_liability"), ("(e) Income-tax assets (net)", "deferred_tax_assets"), ("(a) Short - Term Borrowings", "current_liabilities"),
    ("(e) Short - Term Loans and Advances", "current_assets"), ("TO INTEREST ON VEHICLE LOAN", "interest_finance"), ("Vehicle Loan", "secured_loan_asset_financed"), ("Unsecured Loans", "unsecured_loans"),
    ("Secured Loans", "secured_loan_asset_financed"), ("[EQ] Profit for the Year", "equity_capital"), ("[EXP] Profit for the Year", "__ignored__"), ("[EXP] Sales & Commission", "other_expenses"),
    ("[INC] Transport Movement Charges", "sales_other_income"), ("[EQ] Interest Paid On Housing Loan", "equity_capital"), ("[CL] Provision for tax", "current_liabilities"),
    ("[INV] Loans & Advances", "current_assets"), ("[FA] Mh-12-1615", "fixed_assets"), ("III Total Revenue (I + II)", "__ignored__"), ("Basic (Rs.)", "__ignored__"), ("Mystery Item", None),
    ("Total outstanding dues of micro enterprises", "sundry_creditors"), ("[INC] Closing stock", "purchases"), ("Interest received", None), ("Trade Payables", "sundry_creditors"), ("Total", "__ignored__"),
]
PAGES = [
    ("a", 0, "INDIAN INCOME TAX RETURN ACKNOWLEDGEMENT\nAssessment Year 2023-24 PAN ABCDE1234F ITR-3\nAcknowledgement Number : 123456789012345\nDate 31/07/2023 Status Firm u/s 115BAC"),
    ("a", 1, "BALANCE SHEET AS ON 31st March 2023\nCapital 1,00,000.00\nCreditors 50,000.00\nTotal 1,50,000.00"), ("a", 2, "continued figures 1,000.00"), ("a", 3, "FORM NO. 3CD\nclause 12"), ("a", 4, ""),
    ("b", 0, "some letter"), ("b", 1, "another letter"), ("c", 0, "Balance Sheet as at 31.03.24\nCash 5,000.00"), ("c", 1, "auditors reviewed the long accounts and the balance sheet of the firm"),
    ("c", 2, "Loans from directors & relatives (Unsecured) 5291900\nLoan from bank (secured) 12345000"), ("d", 0, "Profit & Loss A/c for the year ended 31st March, 2024 in Rs. lakhs\n1,00,lO0 and 2,,000,5O0"), ("d", 1, None),
]
HEADINGS = [
    (k, x)
    for k, x in enumerate(
        ["BALANCE SHEET AS ON 31 ST MARCH 2026", "Profit & Loss A/c for the year ended 31-03-24", "carried to balance sheet", "Balance sheet total 1,00,000", "as on 31.03.1999", "for the period ended March 31, 2023",
         "Plot 12, MIDC, Pune 411001", "SHREE GANESH TRADERS", "Note 35 : Lease related disclosures", "Non-Current Liabilities", "EXPENSES", "II. Income", "Current assets", "Secured Loan", "Capital Account",
         "Equity and Liabilities", "Shareholders' Funds", "amounts in Rs. lakhs", "(in Rs. '000)", "in INR crores", "2.35.51,356.00 and 5,106,21", "Proflt & loss 1,234,567,89", "A – B—C"]
    )
]
RETURNS = [
    ("a", 0, "INDIAN INCOME TAX RETURN ACKNOWLEDGEMENT\nCurrent Year business loss, if any 1 48,25,888\nAdjusted gross Total Income 0\nx Total Income 2 0\nTaxes Paid 7 3,19,862\n(+)Tax Payable /(-)Refundable (6-7) 8 (-) 3,19,860"),
    ("a", 1, "COMPUTATION OF INCOME\nNet Profit / (Loss) as per profit & loss A/c (15,32,419)"), ("b", 0, "income from business\nNet profit as per P & L A/c : 12,34,567.00"), ("b", 1, "computation\nNet profit -9,999"), ("c", 0, "nothing"),
]
HEADED = [
    (1, "BALANCE SHEET as on 31-3-2024", "x"), (2, "Trading account", "Sundry creditors"), (3, "Statement A", "Drawings ; Opening capital ; Rent"), (4, "Annexure", "Sales ; Wages ; Rent ; Cash in hand"),
    (5, "Annexure", "Sundry creditors ; Fixed assets ; Sales"), (6, "Capital A/c", "interest"), (7, "nothing", "nothing"), (8, "Capital account of assets", "Purchases"),
]
PAGE_ENDS = [("a", 0, "Balance sheet", "Carried Over 1,00,000"), ("a", 1, "Brought Forward 1,00,000", "Total"), ("a", 2, "Brought forward", "x"), ("b", 0, "b/f", "carried forward"), ("b", 1, "Notes", "y")]
PAGE_ROWS = [(1, 0, "Particulars 2024-2025 2023-2024"), (1, 1, "Sales 1,00,000"), (1, 2, "2019"), (2, 0, "As at 31.03.2025 31.03.2024"), (2, 7, "2011"), (3, 0, "none")]
FIRST = [(1, 121551652, 142291953), (2, 100000, 100500), (3, 0, 0), (4, 100000, 0)]
SECOND = [(1, 295092692, 158468556), (2, 108000, 108001), (3, 7, 7), (4, 100000, 90000)]
RESTATED = [(1, 1, 1, 500, 800), (1, 1, 2, 300, 800), (1, 1, 3, 200, 800), (1, 1, 4, 300, 800), (2, 1, 1, 500, 700), (2, 1, 2, 100, 700), (2, 1, 3, 600, 700), (3, 1, 1, 5, 5), (4, 2, 7, 40, 40), (4, 2, 8, 40, 40)]
ACCOUNT_LINES = [(1, 1, "left", "To Gross Profit c/d", 45), (1, 2, "right", "By Gross Profit b/d", 45), (1, 3, "left", "To Net profit", 9), (2, 1, "left", "To gross prfit trf", 7), (2, 2, "right", "By gross loss", 8)]
CAPTIONS = [(x,) for x in ("Schedule of Sundry Creditors", "Loans with banks", "CASH AT BANK", "to be")]
OVERRIDES = [("Suspense account", "other_expenses"), ("Branch adjustment", "no such row"), ("Total", "debtors")]
