"""Fixed values of the business database: states, operations, page names, labels."""

DATABASE = "retail"

# Operations of a change record.
DIM_OPS = ("insert", "update", "delete", "bootstrap-insert")
FACT_OPS = ("insert", "update", "delete")

# Order, payment and refund states.
ORDER_PLACED = "1001"
ORDER_CANCELLED = "1003"
ORDER_REFUNDED = "1005"
PAYMENT_OPEN = "1601"
PAYMENT_DONE = "1602"
REFUND_ASKED = "0701"
REFUND_GRANTED = "0702"

# Pages and item types of the behaviour log.
HOME = "home"
DETAIL = "good_detail"
SEARCH = "search"
LOGIN = "login"
KEYWORD = "keyword"

# Labels of the dashboard reports.
BACK_USERS = "回流用户数"
ACTIVE_USERS = "活跃用户数"
ORDERS = "订单数"
ORDER_USERS = "下单人数"
REFUNDS = "退单数"
REFUND_USERS = "退单人数"

WINDOW = "5 seconds"
PAY_WITHIN_SECONDS = 30 * 60
BACK_AFTER_DAYS = 7

# Code -> name dictionary of the replayed data (fixed size).
DICTIONARY = [
    ("0701", "refund asked"),
    ("0702", "refund granted"),
    ("1101", "card"),
    ("1102", "wallet"),
    ("1103", "transfer"),
    ("1104", "cash"),
    ("1201", "good"),
    ("1202", "fair"),
    ("1203", "poor"),
    ("1301", "quality"),
    ("1302", "size"),
    ("1303", "late"),
    ("1304", "other"),
    ("1501", "money only"),
    ("1502", "money and goods"),
    ("1601", "open"),
    ("1602", "paid"),
]
