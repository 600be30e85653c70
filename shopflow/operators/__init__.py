"""The analyses, grouped as traffic, pages, funnels (tests), products and users."""
