import datetime as dt

LOG = (
    "order_id string, product_id string, quantity bigint, order_date timestamp_ntz, "
    "price decimal(12,2), customer_id bigint, total decimal(18,4)"
)


def log_of(spark, rows):
    """Rows of (customer, 'YYYY-MM-DD[ HH:MM]', total[, order, product, quantity, price])."""
    from decimal import Decimal

    out = []
    for i, (customer, when, total, *rest) in enumerate(rows):
        order, product, quantity, price = (*rest, *(f"o{i}", "p", 1, 1)[len(rest):])
        money = None if total is None else Decimal(str(total))
        cost = None if price is None else Decimal(str(price))
        out.append((order, product, quantity, dt.datetime.fromisoformat(when), cost, customer, money))
    return spark.createDataFrame(out, LOG)


def rows_of(df, *columns):
    quoted = [f"`{c}`" for c in columns or df.columns]
    return sorted([tuple(r) for r in df.select(*quoted).collect()], key=repr)
