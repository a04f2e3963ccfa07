"""Column expressions shared by the operators; all native, no UDFs."""
