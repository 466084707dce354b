"""guestlens.streaming"""
