"""Column expressions shared by the dashboards."""
