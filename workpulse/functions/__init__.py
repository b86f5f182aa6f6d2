"""Column to column cleaning, all native expressions."""
