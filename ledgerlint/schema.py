"""Column names, typed schemas and rule sets.

Rule sets are plain data; ``ledgerlint.operators.validity`` compiles them to
``Column`` expressions once, at plan time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Columns:
    """Names of the eleven transaction columns in a given table."""

    transaction_id: str = "Transaction ID"
    customer_id: str = "Customer ID"
    category: str = "Category"
    item: str = "Item"
    price: str = "Price Per Unit"
    quantity: str = "Quantity"
    total: str = "Total Spent"
    payment: str = "Payment Method"
    location: str = "Location"
    date: str = "Transaction Date"
    discount: str = "Discount Applied"

    def all(self) -> list[str]:
        """The eleven columns in table order."""
        return [self.transaction_id, self.customer_id, self.category, self.item,
                self.price, self.quantity, self.total, self.payment,
                self.location, self.date, self.discount]


REFERENCE_COLUMNS = Columns()

VIEW_COLUMNS = Columns(
    transaction_id="transaction_id", customer_id="customer_id",
    category="category", item="item", price="price", quantity="quantity",
    total="total_spent", payment="payment_method", location="location",
    date="transaction_date", discount="discount_applied",
)


@dataclass(frozen=True)
class RuleSet:
    """Per-column validity rules (patterns are full-match, ASCII digits)."""

    transaction_pattern: str
    customer_pattern: str
    item_shape: str
    categories: tuple
    abbreviations: tuple  # (category, abbreviation) pairs
    payment_methods: tuple
    locations: tuple
    discount_values: tuple = ("True", "False")
    date_pattern: str = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
    item_pattern: str | None = None  # report-style item format (rule set B)
    extra: dict = field(default_factory=dict)

    def abbreviation_map(self) -> dict:
        return dict(self.abbreviations)


# --- Fixed values: must equal the reference's audit rules (rule set A). ---
REFERENCE_CATEGORIES = (
    "Patisserie", "Milk Products", "Butchers", "Beverages", "Food", "Furniture",
    "Electric household essentials", "Computers and electric accessories",
)
REFERENCE_PAYMENT_METHODS = ("Digital Wallet", "Credit Card", "Cash")
REFERENCE_LOCATIONS = ("Online", "In-store")
REFERENCE_DISCOUNT_VALUES = ("True", "False")
REFERENCE_ABBREVIATIONS = (
    ("Patisserie", "PAT"),
    ("Milk Products", "MILK"),
    ("Butchers", "BUT"),
    ("Beverages", "BEV"),
    ("Food", "FOOD"),
    ("Furniture", "FUR"),
    ("Electric household essentials", "EHE"),
    ("Computers and electric accessories", "CEA"),
)
REFERENCE_TRANSACTION_PATTERN = "TXN_[0-9]{7}"
REFERENCE_CUSTOMER_PATTERN = "CUST_[0-9]+"
REFERENCE_ITEM_SHAPE = "Item_[0-9]+_[A-Za-z]+"
# Rule set B (column reports): two-digit customers, upper-case item suffix.
REPORT_CUSTOMER_PATTERN = "CUST_[0-9]{2}"
REPORT_ITEM_PATTERN = "Item_[0-9]+_[A-Z]+"
# Price master validity range written by the reference's master builder.
MASTER_START = "2021-01-01"
MASTER_END = "2026-12-31"
# --- end of fixed values ---

REFERENCE_RULES = RuleSet(
    transaction_pattern=REFERENCE_TRANSACTION_PATTERN,
    customer_pattern=REFERENCE_CUSTOMER_PATTERN,
    item_shape=REFERENCE_ITEM_SHAPE,
    categories=REFERENCE_CATEGORIES,
    abbreviations=REFERENCE_ABBREVIATIONS,
    payment_methods=REFERENCE_PAYMENT_METHODS,
    locations=REFERENCE_LOCATIONS,
    discount_values=REFERENCE_DISCOUNT_VALUES,
)

REPORT_RULES = RuleSet(
    transaction_pattern=REFERENCE_TRANSACTION_PATTERN,
    customer_pattern=REPORT_CUSTOMER_PATTERN,
    item_shape=REFERENCE_ITEM_SHAPE,
    categories=REFERENCE_CATEGORIES,
    abbreviations=REFERENCE_ABBREVIATIONS,
    payment_methods=REFERENCE_PAYMENT_METHODS,
    locations=REFERENCE_LOCATIONS,
    item_pattern=REPORT_ITEM_PATTERN,
)

# The retail view over the driver tables (see sources.tables): categories are
# the part types, the abbreviation is the first three letters of the type.
VIEW_CATEGORIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
VIEW_RULES = RuleSet(
    transaction_pattern=REFERENCE_TRANSACTION_PATTERN,
    customer_pattern=REFERENCE_CUSTOMER_PATTERN,
    item_shape=REFERENCE_ITEM_SHAPE,
    categories=VIEW_CATEGORIES,
    abbreviations=tuple((c, c[:3]) for c in VIEW_CATEGORIES),
    payment_methods=REFERENCE_PAYMENT_METHODS,
    locations=REFERENCE_LOCATIONS,
    discount_values=REFERENCE_DISCOUNT_VALUES,
    item_pattern=REPORT_ITEM_PATTERN,
)

# Raw transaction table: every field nullable text (mixed-type cells).
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True)
                           for c in REFERENCE_COLUMNS.all()])

TYPED_SCHEMA = T.StructType([
    T.StructField("Transaction ID", T.StringType(), True),
    T.StructField("Customer ID", T.StringType(), True),
    T.StructField("Category", T.StringType(), True),
    T.StructField("Item", T.StringType(), True),
    T.StructField("Price Per Unit", T.DoubleType(), True),
    T.StructField("Quantity", T.DoubleType(), True),
    T.StructField("Total Spent", T.DoubleType(), True),
    T.StructField("Payment Method", T.StringType(), True),
    T.StructField("Location", T.StringType(), True),
    T.StructField("Transaction Date", T.StringType(), True),
    T.StructField("Discount Applied", T.BooleanType(), True),
])

MASTER_SCHEMA = T.StructType([
    T.StructField("Item", T.StringType(), True),
    T.StructField("Price Per Unit", T.DoubleType(), True),
    T.StructField("Start_date", T.StringType(), True),
    T.StructField("End_date", T.StringType(), True),
])

# Weekly target table: text key, integer counts, float everything else.
WEEKLY_INTEGER_COLUMNS = ("unique_transactions", "unique_customers",
                          "discounted_transactions")
