"""Fixed values, and Column expressions built from them."""
