"""Loop driver, derived graphs and the registered queries."""
