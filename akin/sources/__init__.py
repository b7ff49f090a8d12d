"""Reading catalogs and child tables; versioned tables; scratch tables."""
