"""The audit test sheet as fixture rows: one valid base row and one row per
perturbed field (a category row changes its item too). All cells are text,
as a CSV of the sheet holds them; ``None`` is an empty cell."""

BASE = ("TXN_1234567", "CUST_001", "Patisserie", "Item_10_PAT", "18.5", "10", "185",
        "Digital Wallet", "Online", "2025-03-10", "True")
FIELDS = ("Transaction ID", "Customer ID", "Category", "Item", "Price Per Unit", "Quantity",
          "Total Spent", "Payment Method", "Location", "Transaction Date", "Discount Applied")


def _row(**changes):
    r = dict(zip(FIELDS, BASE))
    for k, v in changes.items():
        r[k.replace("_", " ")] = v
    return tuple(r[f] for f in FIELDS)


def _f(field, values):
    return [_row(**{field: v}) for v in values]


def _cat(pairs):
    return [_row(Category=c, Item=i) for c, i in pairs]


def golden_rows():
    rows = [_row()]
    rows += _f("Transaction_ID", ["TXN_12", "TXN_ABCDEFG", "1234567", None, "TXN_"])
    rows += _f("Customer_ID", ["CUST_A1B2", "CUST_", None, "CUSTOMER_123", "CUST_!", "CUST_000"])
    rows += _cat([("Milk Products", "Item_10_MIL"), ("Butchers", "Item_10_BUT"), ("Beverages", "Item_10_BEV"),
                  ("Food", "Item_10_FOOD"), ("Furniture", "Item_10_FURN"),
                  ("Electric household essentials", "Item_10_ELE"),
                  ("Computers and electric accessories", "Item_10_COM"), ("Unknown", "Item_10_PAT"),
                  ("Computers and electric accessories", "Item_10_ELE"), (None, "Item_10_PAT"),
                  ("Patisserie", "Item_10_PAT"), ("Beverages", "Item_20_BEV"), ("Milk Products", "Item_30_MIL"),
                  ("Food", "Item_40_FOOD"), ("Furniture", "Item_50_FURN"),
                  ("Electric household essentials", "Item_60_ELE"),
                  ("Computers and electric accessories", "Item_70_COM"), ("Butchers", "Item_80_BUT"),
                  ("Butchers", "Item_90_UNKNOWN"), ("Butchers", None)])
    rows += [_row(), _row()]
    rows += _f("Price_Per_Unit", ["12", "18.5a", None, "-5", "0", "100", "Twenty", "50.5", "99.99"])
    rows += [_row()]
    rows += _f("Quantity", ["-50", "0", "10A", None, "500", "20.5", "Fifty", "-1", "200"])
    rows += [_row()]
    rows += _f("Total_Spent", ["600", None, "2000B", "-500", "50000", "0", "9999.99", "One Thousand", "1000000"])
    rows += [_row()]
    rows += _f("Payment_Method", ["Credit Card", "Cash", "Bank Transfer", None, "Debit Card", "PayPal", "Crypto",
                                  "Gift Card", "Prepaid"])
    rows += [_row()]
    rows += _f("Location", ["In-store", "Warehouse", None, "Shop", "Kiosk", "Outlet", "Unknown", "Self-service",
                            "Home Delivery"])
    rows += [_row()]
    rows += _f("Transaction_Date", ["2024-02-30", "2024-13-01", "2024-01-32", None, "2024-06-31", "2023-12-31",
                                    "2025-02-29", "01-01-2025", "2024/01/01"])
    rows += [_row()]
    rows += _f("Discount_Applied", ["False", "Yes", "No", None])
    rows += [_row()]
    rows += _f("Discount_Applied", ["False", "TRUE", "FALSE", "Maybe"])
    return rows


# Expected verdict counts (True, False, CANT CHECK, missing) read as CSV text.
EXPECTED = {
    "Transaction ID_validity": (98, 5, 0, 0),
    "Customer ID_validity": (98, 5, 0, 0),
    "Category_validity": (101, 1, 0, 1),
    "Payment Method_validity": (96, 6, 0, 1),
    "Location_validity": (95, 7, 0, 1),
    "Discount Applied_validity": (97, 5, 0, 1),
    "Quantity_validity": (97, 5, 0, 1),
    "Transaction Date_validity": (95, 7, 0, 1),
    "Item_validity": (90, 10, 2, 1),
    "Price Per Unit_validity": (72, 21, 9, 1),
    "Total Spent_validity": (67, 20, 15, 1),
}
