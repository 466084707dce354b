"""guestlens.sources"""
